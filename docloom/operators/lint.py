"""Rule-based lint: pattern, replacement, and how often each applies."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.session import ship

#: The Korean spacing and spelling rules, pattern and replacement.
CORE = (
    (r"할수(?=$|[\s,.!?])", "할 수"),
    (r"할것(?=$|[\s,.!?])", "할 것"),
    (r"하기때문", "하기 때문"),
    (r"(?<!지\s)못하(?=[는여였면지]|$)", "못 하"),
    (r"몇번", "몇 번"),
    (r"(일|주|개월|년)동안", r"\1 동안"),
    (r"(완료|작업|처리|저장|확인)후", r"\1 후"),
    (r"(시작|작업|처리|저장|사용)전", r"\1 전"),
    (r"몇일", "며칠"),
    (r"어떻해", "어떡해"),
    (r"비률", "비율"),
    (r"역활", "역할"),
    (r"결재(?=\s*(?:금액|수단|카드))", "결제"),
)
STEMS = ("할", "될", "볼", "갈", "올", "쓸", "읽을", "먹을", "찾을", "만들", "사용할", "확인할", "처리할", "변경할", "저장할", "삭제할", "추가할", "비교할", "선택할", "다운로드할")
NOUNS = ("수", "때", "뿐", "만큼", "대로", "듯", "리", "바", "것", "데", "중", "후")
#: All rules: the core ones, then every stem with every noun.
RULES = CORE + tuple((rf"{s}{n}(?=$|[\s,.!?])", f"{s} {n}") for s in STEMS for n in NOUNS)


def certain_part(pattern: str) -> str:
    """The longest run of Korean letters that every match of a pattern has."""
    while (inner := re.sub(r"\([^()]*\)", " ", pattern)) != pattern:
        pattern = inner
    return max(re.findall("[\uac00-\ud7a3]+", pattern), key=len)


def leads(pattern: str) -> tuple[int, ...]:
    """How many letters may stand in a match before its certain part: what a leading choice of words leaves open."""
    first = re.match(r"\((?!\?)([^()]*)\)", pattern)
    return tuple(sorted({len(x) for x in first[1].split("|")})) if first else (0,)


class Automaton:
    """Words as an automaton in arrays: goto[state, class of letter], and the words that each state ends.

    All places of a text walk it at once: after the first letter only places that are still within some word go on, so the
    letters looked at are little more than the text has, whatever the number of words.
    """

    def __init__(self, words: Sequence[str]):
        letters = sorted(set("".join(words)))
        self.classes = np.zeros(0x10000, np.int16)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        goto = [[0] * (len(letters) + 1)]
        self.ends: list[tuple[int, ...]] = [()]
        for i, word in enumerate(words):
            state = 0
            for c in word:
                k = int(self.classes[ord(c)])
                if not goto[state][k]:
                    goto[state][k] = len(goto)
                    goto.append([0] * (len(letters) + 1))
                    self.ends.append(())
                state = goto[state][k]
            self.ends[state] += (i,)
        self.goto = np.array(goto, np.int32)
        self.final = np.array([bool(e) for e in self.ends])

    def hits(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], int]:
        """(place, word) of every occurrence in code points, and how many letters were looked at."""
        kind = self.classes[np.where(codes < len(self.classes), codes, 0)]
        at, looked, found = np.arange(len(kind)), len(kind), []
        state = self.goto[0, kind]
        depth = 1
        while True:
            inside = np.flatnonzero(state)
            at, state = at[inside], state[inside]
            done = np.flatnonzero(self.final[state])
            found += [(p, w) for p, s in zip(at[done].tolist(), state[done].tolist()) for w in self.ends[s]]
            going = np.flatnonzero(at + depth < len(kind))
            at, state = at[going], state[going]
            if not len(at):
                return sorted(found), looked
            state = self.goto[state, kind[at + depth]]
            looked += len(at)
            depth += 1


_PATTERNS = [re.compile(p) for p, _ in RULES]
_LEADS = [leads(p) for p, _ in RULES]
AUTOMATON = Automaton([certain_part(p) for p, _ in RULES])


def find(text: str, places: Sequence[tuple[int, int]]) -> list[tuple[str, str, int]]:
    """(before, after, count) of each finding, from the places of the rules' certain parts; only there is a pattern tried.

    A later rule with the same outcome counts, in the earlier one's place.
    """
    hits: dict[int, list[re.Match]] = {}
    for place, rule in places:
        own = hits.setdefault(rule, [])
        for lead in reversed(_LEADS[rule]):
            start = place - lead
            if start >= (own[-1].end() if own else 0) and (m := _PATTERNS[rule].match(text, start)) and m.end() > place:
                own.append(m)
                break
    found: dict[tuple[str, str], int] = {}
    for rule in sorted(r for r, own in hits.items() if own):
        sample = hits[rule][0].group()
        found[sample, _PATTERNS[rule].sub(RULES[rule][1], sample)] = len(hits[rule])
    return [(a, b, n) for (a, b), n in found.items()]


def find_all(texts: Sequence[str]) -> Iterator[tuple[int, list[tuple[str, str, int]]]]:
    """The findings of the texts that have any, by one walk over all of them."""
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    places, _ = AUTOMATON.hits(codes)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    of = np.searchsorted(begin, [p for p, _ in places], "right") - 1
    for i, group in groupby(zip(of.tolist(), places), key=lambda x: x[0]):
        if rows := find(texts[i], [(p - int(begin[i]), w) for _, (p, w) in group]):
            yield i, rows


def findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, seq, before, after, count. One automaton finds where rules may apply; patterns look around only there."""
    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows = [], []
            for i, found in find_all([t or "" for t in batch.column(1).to_pylist()]):
                index += [i] * len(found)
                rows += [(k, *row) for k, row in enumerate(found)]
            if rows:
                made = [pa.array([r[j] for r in rows], x) for j, x in enumerate((pa.int32(), pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), *made], [key, "seq", "before", "after", "count"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, seq int, before string, after string, count long")
