"""Pretty and minified JSON, SQL and XML; plain Python, applied in Arrow batches."""

from __future__ import annotations

import json
import re
from xml.parsers import expat

_SQL = re.compile(
    r"""(?P<quoted>'(?:''|\\.|[^'\\])*'?|"(?:""|\\.|[^"\\])*"?|`(?:``|[^`])*`?)|(?P<comment>(?:--|\#)[^\n]*\n?)|(?P<space>\s+)|(?P<other>.)""",
    re.S | re.X,
)
_SQL_PLAIN = re.compile(_SQL.pattern.replace(r"|\\.|[^'\\]", "|[^']").replace(r'|\\.|[^"\\]', '|[^"]'), re.S | re.X)
_WORDS = re.compile(r"\b(select|from|where|group by|order by|having|limit|(?:left |right |full |inner |cross )?join|on|and|or|union(?: all)?|insert into|values|update|set|delete|as|in|not|null|is|case|when|then|else|end|distinct|with)\b", re.I)
_BREAKS = re.compile(r"\s*\b(FROM|WHERE|GROUP BY|ORDER BY|HAVING|LIMIT|(?:LEFT |RIGHT |FULL |INNER |CROSS )?JOIN|UNION(?: ALL)?|VALUES|SET)\b")


def json_text(text: str, indent: int | None) -> str:
    """Keys keep their order; integers keep all digits."""
    return json.dumps(json.loads(text), ensure_ascii=False, indent=indent, separators=(",", ": ") if indent else (",", ":"))


def sql_minify(text: str, backslash: bool = False) -> str:
    """White space collapsed outside quotes, line comments as block comments."""
    out, gap = "", False
    for m in (_SQL if backslash else _SQL_PLAIN).finditer(text):
        kind, part = m.lastgroup, m.group()
        if kind == "space":
            gap = True
            continue
        if kind == "comment":
            body = part[1 if part[0] == "#" else 2 :].strip().replace("*/", "* /")
            part = f"/* {body} */"
        tight = kind == "other" and (part in ",(" or out[-1:] in (".", "("))
        out += (" " if gap and out and not tight else "") + part
        gap = kind == "comment"
    return out.strip()


def sql_pretty(text: str) -> str:
    """Keywords in upper case, main clauses on lines of their own; its own layout rules."""
    parts = [(m.lastgroup, m.group()) for m in _SQL_PLAIN.finditer(sql_minify(text))]
    out, plain = [], ""
    for kind, part in [*parts, ("quoted", "")]:
        if kind == "quoted":
            up = _WORDS.sub(lambda m: re.sub(r"\s+", " ", m.group()).upper(), plain)
            out += [_BREAKS.sub(lambda m: "\n" + m.group(1), up), part]
            plain = ""
        else:
            plain += part
    return "".join(out).strip()


class XmlError(ValueError):
    """With line and column of the fault."""


def xml_text(text: str, indent: int | None) -> str:
    """Validates, then re-lays elements; text, attributes, CDATA and comments stay as they are, mixed content untouched."""
    out: list[tuple[str, str]] = []
    p = expat.ParserCreate()
    p.ordered_attributes = True
    state = {"cdata": False}
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def start(name, attrs):
        pairs = "".join(f' {k}="{esc(v).replace(chr(34), "&quot;")}"' for k, v in zip(attrs[::2], attrs[1::2]))
        out.append(("open", f"<{name}{pairs}>"))

    p.StartElementHandler = start
    p.EndElementHandler = lambda name: out.append(("close", f"</{name}>"))
    p.CommentHandler = lambda s: out.append(("node", f"<!--{s}-->"))
    p.ProcessingInstructionHandler = lambda t, s: out.append(("node", f"<?{t} {s}?>"))
    p.XmlDeclHandler = lambda v, e, s: out.append(("node", f'<?xml version="{v}"' + (f' encoding="{e}"' if e else "") + "?>"))
    p.StartCdataSectionHandler = lambda: (state.update(cdata=True), out.append(("text", "<![CDATA[")))
    p.EndCdataSectionHandler = lambda: (state.update(cdata=False), out.append(("text", "]]>")))
    p.CharacterDataHandler = lambda s: out.append(("text", s if state["cdata"] else esc(s)))
    try:
        p.Parse(text.encode(), True)
    except expat.ExpatError as e:
        raise XmlError(f"line {e.lineno}, column {e.offset + 1}: {expat.ErrorString(e.code)}") from e
    return _lay_out(out, indent)


def _lay_out(parts: list[tuple[str, str]], indent: int | None) -> str:
    holds_text, stack = {}, []
    for i, (kind, s) in enumerate(parts):
        if kind == "open":
            stack.append(i)
        elif kind == "close":
            stack.pop()
        elif kind == "text" and s.strip() and stack:
            holds_text[stack[-1]] = True
    text, depth, inline = "", 0, 0
    for i, (kind, s) in enumerate(parts):
        if kind == "text":
            text += s if inline else ""
            continue
        if kind == "close":
            depth -= 1
        fresh = indent is not None and not inline and text and not (kind == "close" and parts[i - 1][0] == "open")
        text += ("\n" + " " * (indent * depth) if fresh else "") + s
        if kind == "open":
            depth += 1
            inline += bool(inline or holds_text.get(i))
        elif kind == "close" and inline:
            inline -= 1
    return text
