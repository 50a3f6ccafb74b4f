"""Messages in two languages: results carry codes and values, and are put into words only where they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: code -> English, Korean. Values stand between double braces.
MESSAGES = {
    "NO_FILES": ("There are no files to merge.", "병합할 파일이 없습니다."),
    "NO_SHEETS": ("No sheet of {{file}} was chosen.", "{{file}}에서 선택한 시트가 없습니다."),
    "PASSWORD_REQUIRED": ("{{file}} needs a password.", "{{file}}은(는) 비밀번호가 필요합니다."),
    "UNSUPPORTED_FORMAT": ("{{file}} is of a kind that cannot be read.", "{{file}}은(는) 읽을 수 없는 형식입니다."),
    "TRIM_SKIPPED_FORMULA": ("Empty rows and columns of {{sheet}} stay: it has formulas.", "{{sheet}} 시트에 수식이 있어 빈 행과 열을 그대로 두었습니다."),
    "TRIM_SKIPPED_REFERENCED": ("Empty rows and columns of {{sheet}} stay: formulas of other sheets read it.", "다른 시트의 수식이 {{sheet}} 시트를 읽으므로 빈 행과 열을 그대로 두었습니다."),
    "REFERENCE_EXCLUDED": ("A formula of {{sheet}} reads {{named}}, which is not merged.", "{{sheet}} 시트의 수식이 병합하지 않는 {{named}} 시트를 읽습니다."),
}
_PIECE = r"\{\{[^{}]*\}\}|[^{]+|\{"


def localised(code: Column, values: Column, language: Column) -> Column:
    """The message of a code, with values from a map of names to texts; "en" is English, all else Korean.

    A value that is missing or null is empty, values are not looked into for names, and a code without a message is shown itself.
    """
    texts = [F.create_map(*[F.lit(x) for k, v in MESSAGES.items() for x in (k, v[i])]) for i in (0, 1)]
    own = F.try_element_at(F.when(language == "en", texts[0]).otherwise(texts[1]), F.coalesce(code, F.lit("")))
    fill = lambda p: F.when(p.startswith("{{"), F.coalesce(F.try_element_at(values, F.trim(F.substring(p, 3, 1 << 20).substr(F.lit(1), F.length(p) - 4))), F.lit(""))).otherwise(p)
    return F.coalesce(F.array_join(F.transform(F.regexp_extract_all(own, F.lit(_PIECE), F.lit(0)), fill), ""), code)
