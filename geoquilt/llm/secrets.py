"""Secret scans with a trigram inverted index, in DataFrame functions alone.

Each rule is a regular expression. The literals that every match must contain
give a Boolean query over trigrams: alternatives, each a set of trigrams that
must all occur. One pass posts (trigram, document) for the trigrams that some
rule asks for; intersecting a document's postings with the queries leaves
candidates, and only for those is the expression itself matched. A rule with an
alternative that has no trigram scans all texts in full.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, small_side


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans; pattern: a regular expression; group: its group that must have ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The rules of the base, in their order, then further formats of credentials.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a run of 24 or more is what is left of all runs once shorter ones are dropped
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("github", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(sk|rk)_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{50,}"),
    Rule("azure", r"AccountKey=[A-Za-z0-9+/]{40,}={0,2}"),
    Rule("login", r"(postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._%-]+:[A-Za-z0-9._%!$-]+@[A-Za-z0-9.-]+"),
    # the header, and what follows of the key's body and its end
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----([A-Za-z0-9+/=\x20\x09\x0A\x0D]*-----END [A-Z0-9 ]*PRIVATE KEY-----|[A-Za-z0-9+/=\x20\x09\x0A\x0D]*)"),
)
RULES = BASE_RULES + MORE_RULES

#: Alternatives of a rule beyond which its query is given up and it scans in full.
MOST_ALTERNATIVES = 64
#: Candidates up to which their keys (40 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_CANDIDATES = 500_000

_BREAK = ("", "")


def _literals(parsed) -> list[tuple[str, ...]]:
    """Alternatives of a parsed expression, each the literal pieces that a match has in this order, anything between them."""
    found: list[tuple[str, ...]] = [("",)]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            options = [(chr(arg),)]
        elif name == "BRANCH":
            options = [x for one in arg[1] for x in _literals(one)]
        elif name == "SUBPATTERN":
            options = _literals(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            inside = _literals(inner)
            if least == 0:
                options = [("",), *inside] if most == 1 else [_BREAK]
            else:
                options = inside if most == 1 else [(*x, "") for x in inside]
        elif name == "AT":
            options = [("",)]
        else:
            options = [_BREAK]
        found = list(dict.fromkeys((*a[:-1], a[-1] + b[0], *b[1:]) for a in found for b in options))
        if len(found) > MOST_ALTERNATIVES:
            return [_BREAK]
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The alternatives of a pattern as sets of lower-case trigrams, all of which a match contains; None if one has none."""
    clauses = []
    for pieces in _literals(regex_parser.parse(pattern)):
        grams = {p.lower()[k : k + 3] for p in pieces for k in range(len(p) - 2)}
        if not grams or not all(g.isascii() for g in grams):
            return None
        clauses.append(frozenset(grams))
    return sorted(set(clauses), key=sorted)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost matches of the rule that do not overlap, as an array of (start, rank, end, kind) in code points."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    # what lies before each match gives its place
    each = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), checked.alias("part"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        found = F.when(F.length(x["part"]) >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.aggregate(each, start, step)["found"]


def post_trigrams(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram int, doc_id, text_key): the postings of those trigrams, in lower case, for every whole text."""
    low = docs.select("doc_id", "text_key", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams))))
    return low.select(F.explode(present).alias("gram"), "doc_id", "text_key")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, text, spans (array of start, rank, end, kind by start, then rank), and the columns of ``keep``.

    Places count code points, the end is exclusive. A null text is empty and has
    no spans; rows without an id and rows that repeat one are scanned like any
    other; columns not named are not used; an empty table gives no rows.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries if q for clause in q for g in clause})
    number = {g: k for k, g in enumerate(grams)}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    postings = save(post_trigrams(keyed, grams), "postings")
    held = postings.groupBy("doc_id", "text_key").agg(F.collect_set("gram").alias("grams"))
    matched = [
        F.when(F.exists(F.array(*(F.array(*(F.lit(number[g]) for g in sorted(c))) for c in q)), lambda clause: F.size(F.array_except(clause, F.col("grams"))) == 0), F.lit(k))
        for k, q in enumerate(queries)
        if q
    ]
    if matched:
        held = held.select("doc_id", "text_key", F.array_compact(F.array(*matched)).alias("rules")).where(F.size("rules") > 0)
    else:
        held = held.select("doc_id", "text_key", F.array().cast("array<int>").alias("rules")).where("false")
    held = save(held, "candidates").select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), "rules")
    joined = keyed.join(small_side(held, BROADCAST_CANDIDATES), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")), "left")
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    found = []
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        asked = F.array_contains("rules", F.lit(k)) if query else F.rlike("text", F.lit(rule.pattern))
        found.append(F.when(asked, _spans(F.col("text"), rule, k)).otherwise(empty))
    return joined.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("spans"), *(F.col(f"kept_{c}").alias(c) for c in keep))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or union of overlapping spans, replaced by its first kind in brackets."""
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        done = F.when(new, F.concat(acc["done"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def _sql_spans(rank: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""list_transform(
        list_filter(range(1, len(h{rank}) + 1), lambda i: length(p{rank}[i]) >= {rule.least}),
        lambda i: {{'s': coalesce(list_sum(list_transform(g{rank}[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(h{rank}[1:i - 1], lambda x: length(x))), 0)::BIGINT,
                    'r': {rank}, 'n': length(h{rank}[i])::BIGINT, 'k': '{rule.kind}'}}) AS f{rank}""", f"""string_split_regex(t, '{pattern}') AS g{rank},
        regexp_extract_all(t, '{pattern}') AS h{rank}, regexp_extract_all(t, '{pattern}', {rule.group}) AS p{rank}"""


def oracle_sql() -> str:
    """DuckDB SQL of the query op8: each rule matched against every text."""
    parts = [_sql_spans(k, r) for k, r in enumerate(RULES)]
    joined = lambda spans: f"array_to_string(list_transform({spans}, lambda x: concat(x.k, ':', x.s, ':', x.s + x.n)), ',')"
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    matches AS (SELECT doc_id, {", ".join(p[1] for p in parts)} FROM texts),
    spans AS (SELECT doc_id, {", ".join(p[0] for p in parts)} FROM matches),
    sorted AS (SELECT *, list_sort({" || ".join(f"f{k}" for k in range(len(RULES)))}) AS a,
               list_sort(f0 || f1 || f2) AS b FROM spans)
    SELECT doc_id, len(f0)::BIGINT AS n_assign, len(f1)::BIGINT AS n_access, len(f2)::BIGINT AS n_hex,
           sha256(coalesce({joined("b")}, '')) AS base_sha256, coalesce({joined("a")}, '') AS spans
    FROM sorted"""
