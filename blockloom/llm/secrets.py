"""Secret scans through a trigram inverted index, with DataFrame functions only.

Planning (driver, on the fixed rules): from each rule's regular expression a Boolean
trigram query is derived. Literal runs that every match must hold become clauses; a run
with alternatives becomes an OR of ANDs of its strings' trigrams. Letters are compared in
lower case, so a query asks for no more than the expression does.

Index: postings (trigram, row) of the trigrams that queries name. The postings of a row
meet in bit masks (partial sums before the shuffle), each rule's query is a test of the
masks, and rows that pass some query are the candidates. Candidates are written once and
joined back by size. Each rule then verifies its candidates with its full expression.
Rules without mandatory trigrams scan all rows.

Spans are leftmost, non-overlapping per rule; code points, end exclusive. Results are per
row: null texts count as empty and have no spans, repeated rows get equal spans, an empty
table an empty result. Only id and text are read besides ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count where group ``group`` has ``least`` or more characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds, in their order. The long forms skip exactly the matches that are too short.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Published forms of service tokens and keys.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"://[A-Za-z0-9._~-]+:[^\x20\x09-\x0D/@:]{3,}@"),
)
RULES = BASE + MORE

_LABEL = r"(?:[A-Z0-9]{1,16}\x20){0,4}PRIVATE KEY(?: BLOCK)?-----"
_GAP = r"(?:[\x20\x09-\x0D\x22'>#,|*;+]|\\[nrt])*+"
_HEADER = r"Proc-Type:\x204,ENCRYPTED|DEK-Info:\x20[A-Z0-9-]+(?:,[0-9A-Fa-f]+)?|(?:Version|Comment|Hash|Charset):[^\x0A\x0D\x5C]{0,200}(?=[\x0A\x0D\x5C])"
_SHORT = rf"{_GAP}[A-Za-z0-9+/]{{1,63}}={{1,2}}|[\x09-\x0D]++[A-Za-z0-9+/=]{{1,63}}(?![^\x09-\x0D])"
#: All of a PEM or armoured private key: to its END, or else its headers and base64 lines. Loops are possessive, so long bodies take no stack.
PRIVATE_KEY = rf"-----BEGIN {_LABEL}(?:(?:[^-]++|-(?!----))*+-----END {_LABEL}|(?:(?:{_GAP}(?:{_HEADER}|[A-Za-z0-9+/]{{16,}}+={{0,2}}))++(?:{_SHORT}){{0,2}}+)?+)"
#: The rules to redact by: of a private key more than the line that tells it, which is what ``RULES`` and op5's SQL list.
REDACTED = tuple(Rule(r.kind, PRIVATE_KEY) if r.kind == "private_key" else r for r in RULES)

_MOST = 64  # strings that a run may stand for
_MASK = 60  # bits used of a mask


def _strings(items) -> set[str] | None:
    """All strings, in lower case, that a sequence can match, or None where these aren't few."""
    out = {""}
    for item in items:
        own = _item_strings(item)
        if own is None or len(out) * len(own) > _MOST:
            return None
        out = {a + b for a, b in product(out, own)}
    return out


def _item_strings(item) -> set[str] | None:
    op, arg = str(item[0]), item[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "AT":
        return {""}
    if op == "SUBPATTERN":
        return _strings(arg[-1])
    if op == "BRANCH":
        each = [_strings(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op == "IN" and str(arg[0][0]) != "NEGATE":
        out = set()
        for kind, v in arg:
            if str(kind) == "LITERAL":
                out.add(chr(v).lower())
            elif str(kind) == "RANGE" and v[1] - v[0] < 8:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op == "MAX_REPEAT" and arg[1] <= 3:
        own = _strings(arg[2])
        if own is not None and len(own) ** int(arg[1]) <= _MOST:
            return {"".join(x) for n in range(arg[0], int(arg[1]) + 1) for x in product(own, repeat=n)}
    return None


def _runs(items, out: list[set[str]]) -> None:
    """The literal runs that every match holds, each as its possible strings."""
    current = {""}
    for item in items:
        own = _item_strings(item)
        if own is not None and len(current) * len(own) <= _MOST:
            current = {a + b for a, b in product(current, own)}
            continue
        out.append(current)
        current = {""} if own is None else own
        op, arg = str(item[0]), item[1]
        if own is None and op == "SUBPATTERN":
            _runs(arg[-1], out)
        elif own is None and op == "MAX_REPEAT" and arg[0] >= 1:
            _runs(arg[2], out)
    out.append(current)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """An AND of ORs of ANDs of trigrams; empty where none is mandatory."""
    runs: list[set[str]] = []
    _runs(sre.parse(pattern), runs)
    query = []
    for run in runs:
        least = [s for s in run if not any(o != s and o in s for o in run)]
        if all(len(s) >= 3 for s in least):
            query.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in least}, key=sorted))
    return query


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def _starts(steps: Column, block: int = 256) -> Column:
    """For each place the sum of the steps before it; by blocks, so long arrays take no quadratic time."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int"))
    sums = F.transform(blocks, lambda b: _sum(F.slice(steps, b * block + 1, F.lit(block))))
    bases = lambda s: F.transform(s, lambda _, b: _sum(F.slice(s, F.lit(1), b)))
    place = lambda base: F.transform(steps, lambda _, i: F.element_at(base, F.floor(i / block).cast("int") + 1) + _sum(F.slice(steps, F.floor(i / block).cast("int") * block + 1, i % block)))
    return _let(sums, lambda s: _let(bases(s), place))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, k, end, kind>> of a rule's matches in a text."""

    def body(x: Column) -> Column:
        gaps, hits, checked = x["gaps"], x["hits"], x["checked"]
        steps = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))
        found = lambda starts: F.filter(
            F.transform(hits, lambda h, i: F.struct(
                (F.get(starts, i) + F.length(F.get(gaps, i))).alias("start"), F.lit(order).alias("k"),
                (F.get(starts, i) + F.length(F.get(gaps, i)) + F.length(h)).alias("end"), F.lit(rule.kind).alias("kind"),
                F.length(F.get(checked, i)).alias("n"))),
            lambda s: s["n"] >= rule.least,
        )
        return _let(_let(steps, lambda v: _starts(v)), found)

    p = F.lit(rule.pattern)
    parts = F.struct(F.split(text, rule.pattern, -1).alias("gaps"), F.regexp_extract_all(text, p, F.lit(0)).alias("hits"), F.regexp_extract_all(text, p, F.lit(rule.group)).alias("checked"))
    return F.when(text.rlike(rule.pattern), _let(parts, body))


def candidates(docs: DataFrame, text: str, key: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """``key`` and the bit mask ``rules`` of the rules whose trigram query a row passes."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({t for q in queries for clause in q for alt in clause for t in alt})
    bit = {t: divmod(i, _MASK) for i, t in enumerate(wanted)}
    masks = range(-(-len(wanted) // _MASK))
    terms = F.array(*[F.struct(F.lit(t).alias("t"), *[F.lit((1 << b) if m == w else 0).cast("long").alias(f"m{m}") for m in masks]) for t, (w, b) in bit.items()])
    postings = docs.select(*key, F.lower(F.col(text)).alias("low")).withColumn("q", F.explode(terms)).where(F.contains("low", F.col("q.t")))
    rows = postings.groupBy(*key).agg(*[F.bit_or(f"q.m{m}").alias(f"m{m}") for m in masks])

    def passes(alt: frozenset[str]) -> Column:
        need = [sum(1 << bit[t][1] for t in alt if bit[t][0] == m) for m in masks]
        tests = [F.col(f"m{m}").bitwiseAND(F.lit(n).cast("long")) == n for m, n in zip(masks, need, strict=True) if n]
        out = tests[0]
        for t in tests[1:]:
            out &= t
        return out

    verdict = F.lit(0)
    for i, q in enumerate(queries):
        if q:
            test = F.lit(True)
            for clause in q:
                some = F.lit(False)
                for alt in clause:
                    some |= passes(alt)
                test &= some
            verdict = verdict.bitwiseOR(F.when(test, F.lit(1 << i)).otherwise(0))
    return rows.select(*key, verdict.alias("rules")).where("rules > 0")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``spans``, array<struct<start, k, end, kind>> by start, then rule."""
    full = [i for i, r in enumerate(rules) if not trigram_query(r.pattern)]
    chosen = docs.select(*keep, F.col(doc_id).alias("scan_id"), text_or_empty(text).alias("scan_text")).withColumn("scan_hash", F.xxhash64("scan_text"))
    found = staged(candidates(chosen.select("scan_id", "scan_hash", "scan_text"), "scan_text", ["scan_id", "scan_hash"], rules), "candidates")
    found = found.select(F.col("scan_id").alias("i"), F.col("scan_hash").alias("h"), "rules")
    rows = chosen.join(found, F.col("i").eqNullSafe(F.col("scan_id")) & (F.col("h") == F.col("scan_hash")), "left")
    hit = lambda i: F.coalesce(F.col("rules").bitwiseAND(F.lit(1 << i)) != 0, F.lit(False))
    t = F.col("scan_text")
    each = [spans(t, r, k) if k in full else F.when(hit(k), spans(t, r, k)) for k, r in enumerate(rules)]
    none = F.array().cast("array<struct<start:int,k:int,end:int,kind:string,n:int>>")
    every = F.array_sort(F.flatten(F.array(*[F.coalesce(x, none) for x in each])))
    every = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.select(*keep, every.alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span as ``[kind]``; a span that begins inside another is part of it."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, cut).otherwise(text)
