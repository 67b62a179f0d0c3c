"""Secret scan with a trigram inverted index (built-in column functions only).

1. Each rule's regular expression is parsed and turned into a Boolean trigram
   query: an AND of clauses, each an OR of trigram sets (``trigram_query``).
   Only trigrams that some query names enter the index.
2. ``postings`` holds one row per (trigram, document). The lists are intersected
   per document, which leaves for each document the rules that can match there.
3. Candidates are verified with the expression itself. A rule without a mandatory
   trigram (a bare character class) is verified on every document.

Spans are code-point offsets, end exclusive. Positions come from marking every
match with a control character and splitting there, so they are those of the
leftmost non-overlapping matches.

Defined results: a null text counts as empty; an empty text has no spans; rows
are kept one for one (repeated rows and null keys included); columns of the
input keep their values unless an output column has the same name, in which case
the output column replaces it.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, MARK_STAND_IN = "\x01", "\x02"


@dataclass(frozen=True)
class Rule:
    """``pattern`` must mean the same in Java and Python; ``group`` (0: the whole
    match) must have ``min_length`` characters, checked after matching."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1
    ignore_case: bool = False


# The three base kinds, in the order in which ties are listed.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


# -- Boolean trigram queries -------------------------------------------------

_MAX_STRINGS = 64  # beyond this many alternatives a run of characters is cut


def _strings(node) -> set[str] | None:
    """The finite set of strings a parse node can match; None if not (usefully) finite."""
    op, arg = node
    if op is rc.LITERAL:
        return {chr(arg)}
    if op is rc.IN:
        if any(o is not rc.LITERAL for o, _ in arg) or len(arg) > 8:
            return None
        return {chr(a) for _, a in arg}
    if op is rc.SUBPATTERN:
        return _product(list(arg[-1]))
    if op is rc.BRANCH:
        parts = [_product(list(x)) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is rc.MAX_REPEAT and arg[:2] == (0, 1):
        inner = _product(list(arg[2]))
        return None if inner is None else {"", *inner}
    return None


def _product(nodes: list) -> set[str] | None:
    out = {""}
    for node in nodes:
        s = _strings(node)
        if s is None or len(out) * len(s) > _MAX_STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def _runs(nodes: list):
    """The finite string sets that every match contains, in order."""
    run: set[str] = {""}
    for node in nodes:
        op, arg = node
        s = _strings(node)
        if s is not None and len(run) * len(s) <= _MAX_STRINGS:
            run = {a + b for a in run for b in s}
            continue
        yield run
        run = {""} if s is None else s
        if s is None and op is rc.SUBPATTERN:
            yield from _runs(list(arg[-1]))
        elif s is None and op is rc.MAX_REPEAT and arg[0] >= 1:
            yield from _runs(list(arg[2]))
    yield run


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of ORs of trigram sets (lower case) that any text with a match satisfies.

    An empty list means that no trigram is mandatory.
    """
    clauses = []
    for run in _runs(list(rp.parse(pattern))):
        sets = {frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in run}
        if frozenset() in sets:
            continue  # some alternative is shorter than a trigram
        least = [s for s in sets if not any(o < s for o in sets)]
        clauses.append(sorted(least, key=sorted))
    return clauses


# -- index and candidates ----------------------------------------------------


def postings(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index for the given trigrams: rows (trigram, key)."""
    # the one-element array binds the lowered text once for all the look-ups
    held = F.transform(
        F.array(F.lower(F.coalesce(F.col(text), F.lit("")))),
        lambda low: F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda g: F.contains(low, g)),
    )[0]
    return docs.select(F.explode(held).alias("trigram"), F.col(key).alias("_key"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kinds): the indexed rules whose Boolean query the document's postings satisfy."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({t for q in queries.values() for clause in q for s in clause for t in s})
    sets = postings(docs, grams, key, text).groupBy("_key").agg(F.collect_set("trigram").alias("_grams"))

    def holds(query) -> Column:
        out = F.lit(True)
        for clause in query:
            any_of = F.lit(False)
            for s in clause:
                need = F.array(*[F.lit(t) for t in sorted(s)])
                any_of = any_of | (F.size(F.array_except(need, "_grams")) == 0)
            out = out & any_of
        return out

    kinds = F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()])
    return sets.select("_key", F.array_compact(kinds).alias("_kinds")).filter(F.size("_kinds") > 0)


# -- verification ------------------------------------------------------------


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, kind, end>> of the rule's matches in ``text`` (not null)."""
    java = ("(?i)" if rule.ignore_case else "") + rule.pattern
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, MARK_STAND_IN)).otherwise(text)
    parts = F.split(F.regexp_replace(clean, F.lit(java), F.lit(f"{MARK}$0{MARK}")), MARK, -1)

    kept = lambda p: F.length(F.regexp_extract(p, java, rule.group) if rule.group else p) >= rule.min_length
    empty = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        end = acc["pos"] + F.length(p)
        hit = F.struct(
            acc["pos"].alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end")
        )
        found = F.when((acc["i"] % 2 == 1) & kept(p), F.concat(acc["out"], F.array(hit))).otherwise(acc["out"])
        return F.struct(end.alias("pos"), (acc["i"] + 1).alias("i"), found.alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("i"), empty.alias("out"))
    scanned = F.aggregate(parts, start, step, lambda acc: acc["out"])
    # a cheap test first: the shortest match that can be kept
    return F.when(F.rlike(text, F.lit(_test(rule))), scanned).otherwise(empty)


def _test(rule: Rule) -> str:
    java = ("(?i)" if rule.ignore_case else "") + rule.pattern
    if rule.group == 0 and rule.min_length > 1 and java.endswith("]+") and java.startswith("["):
        return f"{java[:-1]}{{{rule.min_length},}}"  # one class repeated: runs are maximal
    return java


def scan_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES,
) -> DataFrame:
    """``docs`` with ``secret_spans``: array<struct<start, ord, kind, end>> sorted by
    start, then rule order. ``ord`` is the rule's place in ``rules``.
    """
    found = candidates(docs, rules, key, text)
    rows = docs.drop("secret_spans", "_key", "_kinds")
    joined = rows.join(found, rows[key].eqNullSafe(found["_key"]), "left")
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    spans = []
    for i, rule in enumerate(rules):
        hit = _spans(body, rule, i)
        if trigram_query(rule.pattern):
            hit = F.when(F.array_contains("_kinds", rule.kind), hit).otherwise(none)
        spans.append(hit)
    return joined.select(*rows.columns, F.array_sort(F.concat(*spans)).alias("secret_spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
    )
