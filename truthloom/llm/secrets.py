"""Secret scans over a trigram index (operator 3).

Each rule's regular expression is turned into a Boolean query: an OR of alternatives, each an AND
of the trigrams that every match of this alternative must contain.  A task indexes its slice of
texts (lower-cased bytes, trigram -> sorted texts), answers the queries by intersecting and
uniting postings, and runs the expressions only over the candidates.  A rule with an alternative
that has no mandatory trigram, such as a run of hexadecimal digits, scans every text.

Null texts count as empty and have no spans; duplicated rows are scanned alike; extra columns are
ignored by ``scan_secrets`` and kept by ``redact_secrets``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import re._parser as parser
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from truthloom.llm.spans import Span, as_text, digest, in_order
from truthloom.llm.words import chunks, text_bytes

#: A class with more characters than this ends a literal run.
CLASS_CHARS = 8
#: A step that would make more alternatives than this counts as unknown text.
ALTERNATIVES = 64
MARK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """``least`` code points are needed in ``group`` of a match (0: the whole match)."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0


# The three base rules.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.ASCII | re.IGNORECASE, group=2, least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# The BEGIN line, the key's lines of base64 and headers, and the END line if the key is whole.  Line breaks may be
# escaped, lines quoted or indented; a short run of base64 belongs to the key only where its line ends.
_BREAK = r"(?:[\r\n]|\\[rn]|-----END )"
_BETWEEN = r"(?:\\[nrt]?|-(?!----)|[^A-Za-z0-9+/=\\-])*+"
_REST = r"(?:\\(?![rn])|-(?!----)|[^A-Za-z0-9+/=\\\r\n-])*+"
_HEADER = r"(?:Proc-Type|DEK-Info|Comment|Subject|X-[A-Za-z-]{1,30}):[^\r\n\\]*+"
_BODY = rf"(?:{_BETWEEN}(?:[A-Za-z0-9+/=]{{16,}}+|{_HEADER}|[A-Za-z0-9+/=]++(?={_REST}{_BREAK})))*+"
PRIVATE_KEY = rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----{_BODY}(?:{_BETWEEN}-----END [A-Z ]{{0,20}}PRIVATE KEY-----)?+"
MORE_RULES = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", PRIVATE_KEY),
)
RULES = BASE_RULES + MORE_RULES

_GAP = None  # stands for any text inside an alternative
_UNKNOWN = [(_GAP,)]


def _alternatives(nodes) -> list[tuple]:
    """Every way through a sequence of nodes: characters, and gaps for unknown text."""
    ways: list[tuple] = [()]
    for op, arg in nodes:
        step = _one(str(op), arg)
        if len(ways) * len(step) > ALTERNATIVES:
            step = _UNKNOWN
        ways = [a + b for a in ways for b in step]
    return ways


def _fold(code: int) -> str:
    return chr(code).lower() if code < 128 else chr(code)


def _one(op: str, arg) -> list[tuple]:
    if op == "LITERAL":
        return [(_fold(arg),)]
    if op == "IN":
        if all(str(kind) == "LITERAL" for kind, _ in arg) and len(arg) <= CLASS_CHARS:
            return [(_fold(code),) for _, code in arg]
        return _UNKNOWN
    if op == "SUBPATTERN":
        return _alternatives(arg[-1])
    if op == "BRANCH":
        return [way for branch in arg[1] for way in _alternatives(branch)]
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = arg
        ways = _alternatives(inner)
        if (least, most) == (0, 1):
            return [(), *ways]
        if least == 0:
            return _UNKNOWN
        return [way + (_GAP,) for way in ways] if (least, most) != (1, 1) else ways
    if op in ("AT", "ASSERT", "ASSERT_NOT"):
        return [()]
    return _UNKNOWN


def trigram_query(pattern: str, flags: int = 0) -> list[frozenset[bytes]] | None:
    """OR of ANDs of mandatory trigrams, lower-cased; None where some match may have none."""
    query = set()
    for way in _alternatives(parser.parse(pattern, flags)):
        grams, run = set(), ""
        for char in (*way, _GAP):
            if char is _GAP:
                run = ""
                continue
            run += char
            raw = run.encode()
            if len(raw) >= 3:
                grams.add(raw[-3:])
        if not grams:
            return None
        query.add(frozenset(grams))
    return sorted(query, key=sorted)


class Scanner:
    """The compiled rules and the query of each."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = tuple(rules)
        self.kinds = [rule.kind for rule in self.rules]
        self.compiled = [re.compile(rule.pattern, rule.flags) for rule in self.rules]
        self.queries = [trigram_query(rule.pattern, rule.flags) for rule in self.rules]
        grams = sorted({g for query in self.queries if query for way in query for g in way})
        self.gram_id = {g: i for i, g in enumerate(grams)}
        self.table = np.full(1 << 24, -1, np.int16)
        for gram, i in self.gram_id.items():
            self.table[gram[0] << 16 | gram[1] << 8 | gram[2]] = i

    def postings(self, texts: pa.Array) -> list[np.ndarray]:
        """For each trigram of the queries, the sorted texts that have it."""
        data, offsets = text_bytes(texts)
        found = np.zeros(0, np.int64), np.zeros(0, np.int16)
        if len(data) >= 3:
            low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int32)
            ids = self.table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            at = np.flatnonzero(ids >= 0)
            row = np.searchsorted(offsets, at, side="right") - 1
            inside = at + 3 <= offsets[row + 1]
            found = row[inside], ids[at[inside]]
        return [np.unique(found[0][found[1] == i]) for i in range(len(self.gram_id))]

    def candidates(self, texts: pa.Array) -> list[np.ndarray]:
        """For each rule, the texts that its expression has to be run over."""
        postings = self.postings(texts)
        every = np.arange(len(texts))
        found = []
        for query in self.queries:
            if query is None:
                found.append(every)
                continue
            rows = np.zeros(0, np.int64)
            for way in query:
                lists = sorted((postings[self.gram_id[g]] for g in way), key=len)
                held = lists[0]
                for other in lists[1:]:
                    held = held[np.isin(held, other, assume_unique=True)]
                rows = np.union1d(rows, held)
            found.append(rows)
        return found

    def verify(self, rule: int, text: str) -> list[Span]:
        """Leftmost non-overlapping matches of one rule, without those that are too short."""
        own = self.rules[rule]
        return [
            (own.kind, *m.span())
            for m in self.compiled[rule].finditer(text)
            if m.end(own.group) - m.start(own.group) >= own.least
        ]

    def scan(self, texts: pa.Array) -> list[list[Span]]:
        """All spans of every text, in order."""
        spans: list[list[Span]] = [[] for _ in range(len(texts))]
        held = texts.to_pylist()
        for rule, rows in enumerate(self.candidates(texts)):
            for row in rows.tolist():
                if held[row]:
                    spans[row] += self.verify(rule, held[row])
        return [in_order(found, self.kinds) for found in spans]


def _strings(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def scan_secrets(docs: DataFrame, more: Sequence[Rule] = MORE_RULES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the base rules, their digest, all spans."""
    rules = BASE_RULES + tuple(more)
    base = [rule.kind for rule in BASE_RULES]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in chunks(batch):
                found = scanner.scan(part.column("text"))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    **{f"n_{k}": pa.array([sum(s[0] == k for s in row) for row in found], pa.int64()) for k in base},
                    "base_sha256": pa.array([digest(as_text(s for s in row if s[0] in base)) for row in found], pa.string()),
                    "spans": pa.array([as_text(row) for row in found], pa.string()),
                })

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return _strings(docs).mapInArrow(scan, schema)


def _blot(text: str, spans: Sequence[Span], mark: str) -> str:
    """The text with every stretch covered by spans replaced by one mark."""
    out, at = [], 0
    stretches: list[list[int]] = []
    for _, start, end in spans:
        if stretches and start <= stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], end)
        else:
            stretches.append([start, end])
    for start, end in stretches:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, more: Sequence[Rule] = MORE_RULES, mark: str = MARK) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; other columns as they are.

    A column ``n_chars`` follows the new text.  No row is dropped; null texts stay null.
    """
    rules = BASE_RULES + tuple(more)
    place = docs.columns.index("text")

    def redact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in chunks(batch):
                texts = part.column(place)
                held = texts.to_pylist()
                for row, spans in enumerate(scanner.scan(texts)):
                    if spans:
                        held[row] = _blot(held[row], spans, mark)
                columns = [*part.columns]
                columns[place] = pa.array(held, texts.type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    fields = [StructField(f.name, StringType() if f.name == "text" else f.dataType) for f in docs.schema]
    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(redact, StructType(fields))
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, LongType):
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out
