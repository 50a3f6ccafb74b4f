"""Quality rules in a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps one bit per failed rule beside the
measurements. A policy is a named, versioned set of rules: applying one, comparing two, or asking what a
rule adds is bit arithmetic on the ledger, without reading a text again.

Words are runs of anything but ASCII white space. Nulls and edge cases: null text has no words and fails
the rule on few words alone; repeated rows are judged one by one; an empty table gives an empty ledger; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import hashing
from docloom.llm.common import binary_list, chunks, lean, ready

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words", "n_letters", "dup_line_chars")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LOWER = (np.zeros(256, bool) for _ in range(2))
_UPPER[65:91] = True
_LOWER[97:123] = True
_LETTER = _UPPER | _LOWER
_LETTER[0xC3:0xF5] = True  # the first byte of a character beyond ASCII and Latin-1 signs
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False

_SPACES = b" \t\n\x0b\x0c\r"

#: (name, the failing condition over the measurements). A rule's place is its bit; rules are only appended.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("short_words", "2 * word_chars < 5 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "100 * n_capital_words > 40 * n_words"),
    ("few_letters", "100 * n_letters < 60 * word_chars"),
    ("repeated_line_text", "100 * dup_line_chars > 60 * word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base-1": BASE,
    "web-1": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["short_words"] | BIT["long_words"],
    "web-2": sum(BIT.values()),
}


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    out = {}

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[np.minimum(begin + [len(t) for t in texts], len(data))] - total[np.minimum(begin, len(data))]

    out["word_chars"] = per_text(_POINT[data] & ~hashing.SPACE[data])
    out["n_symbols"] = per_text(_SYMBOL[data])
    out["n_letters"] = per_text(_LETTER[data])
    start, end = hashing.words(data)
    doc = np.searchsorted(begin, start, "right") - 1
    out["n_words"] = np.bincount(doc, minlength=n)
    upper, lower = (np.concatenate(([0], np.cumsum(x[data]))) for x in (_UPPER, _LOWER))
    capital = (upper[end] - upper[start] >= 2) & (lower[end] == lower[start])
    out["n_capital_words"] = np.bincount(doc[capital], minlength=n)
    h = hashing.spans(hashing.prefix(data), start, end)
    seen = np.zeros(len(h), bool)
    if len(h) >= 3:
        at = np.flatnonzero(doc[:-2] == doc[2:])
        x = hashing.mix(hashing.mix(hashing.mix(h[at]) + h[at + 1] * hashing.U(3)) + h[at + 2] * hashing.U(5) + hashing.mix(doc[at].astype(np.uint64)))
        order = np.argsort(x, kind="stable")
        equal = x[order][1:] == x[order][:-1]
        twice = order[np.concatenate((equal, [False])) | np.concatenate(([False], equal))] if len(order) else order
        for j in range(3):
            seen[at[twice] + j] = True
    out["n_repeat_words"] = np.bincount(doc[seen], minlength=n)
    lines = np.zeros((3, n), np.int64)
    for i, t in enumerate(texts):
        known: set[bytes] = set()
        own = [x for x in t.split(b"\n") if x.strip(_SPACES)]
        lines[0, i] = len(own)
        if len(own) > 1:
            for x in own:
                if x in known:
                    lines[1, i] += 1
                    lines[2, i] += len(x.translate(None, _SPACES).decode("utf-8", "replace"))
                known.add(x)
    out["n_lines"], out["n_dup_lines"], out["dup_line_chars"] = lines
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, failed (bits by rule), the measurements."""
    ready(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in binary_list(batch.column(1))]
            for a, b in chunks([len(t) for t in texts]):
                m = measure(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(m[x].astype(np.int64)) for x in MEASURES]], ["doc_id", *MEASURES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(make), "doc_id long, " + ", ".join(f"{x} long" for x in MEASURES))
    failed = " + ".join(f"CASE WHEN {rule} THEN {1 << i}L ELSE 0L END" for i, (_, rule) in enumerate(RULES))
    return rows.select("doc_id", F.expr(failed).alias("failed"), *MEASURES)


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """One row per rule of the policy: documents that fail it, and documents that it alone rejects."""
    mask = POLICIES[policy]
    own = F.col("failed").bitwiseAND(F.lit(mask))
    bits = [(i, name) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    counts = rows.agg(
        F.count("*").alias("documents"),
        F.count_if(own != 0).alias("rejected"),
        *[F.count_if(own.bitwiseAND(F.lit(1 << i)) != 0).alias(f"f{i}") for i, _ in bits],
        *[F.count_if(own == (1 << i)).alias(f"o{i}") for i, _ in bits],
    )
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"f{i}").alias("failed"), F.col(f"o{i}").alias("only")) for i, name in bits]))
    return counts.select(F.lit(policy).alias("policy"), "documents", "rejected", each.alias("x")).select("policy", "documents", "rejected", "x.rule", "x.failed", "x.only")


def judge(docs: DataFrame, policy: str = "web-2") -> DataFrame:
    """doc_id, n_words and the other measurements, failed, base_failed, kept."""
    rows = ledger(docs)
    return rows.withColumn("base_failed", ~passes("base-1")).withColumn("kept", passes("base-1") & passes(policy))
