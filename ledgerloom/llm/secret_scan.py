"""Secret scanning with a trigram inverted index.

Each rule's pattern is parsed with Python's own regex parser on the driver, and a Boolean query over trigrams that any
match must contain is derived from it: AND along a sequence, OR over alternatives. The index holds postings
(trigram, document key) of exactly the trigrams that some query asks for. Postings of one document meet in one small row,
so a trigram that occurs everywhere never gathers in a task; intersecting is a bit test. Candidates are verified by the
full pattern. Texts travel to verification only if they hold the anchor trigrams: for each way to satisfy a rule, its
trigram with the shortest posting list. Rules without a mandatory trigram are scanned over every text.

Base rules: assign, access, hex. Rules of the method itself: private key blocks, web tokens, and tokens with a vendor's
prefix; a span of theirs that overlaps a base span of any kind is left out, so base spans stay as they are.

Patterns run in Java. Matches are leftmost and don't overlap within a rule; matches below the rule's length are dropped
after matching. Spans are in code points, end exclusive.

Defined results: null counts as empty and has no spans; the key of a document is its id and a hash of its text, so
repeated ids, repeated rows and null ids are no problem; spans that start together are in the order of the rules; very long texts
are scanned whole, and no pattern has a repeated group, in which Java would recurse for each repeat; an empty table gives
no rows; other columns are ignored, so they may have any name.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import read, shared_if_small, stored


@dataclass(frozen=True)
class Rule:
    """group: the part of a match whose length in characters must be at least `least`."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Fixed values of the contract: names, patterns and lengths, in order.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
]
EXTRA = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("vendor_token", r"(?:ghp_|gho_|xoxb-|xoxp-|sk_live_)[A-Za-z0-9-]+", 0, 20),
]
RULES = BASE + EXTRA
#: Matches whose places are added up in one go.
GROUP = 128
#: Ways to satisfy a rule that a query may list before it gives up and has the rule scan fully.
MOST_WAYS = 64


def _literals(node, fold: bool) -> set[str] | None:
    """All strings a short node can match, or None if they are many or unbounded. Lower-cased: the index folds ASCII case."""
    op, arg = node
    if op is rc.LITERAL:
        return {chr(arg).lower()} if arg < 128 else {chr(arg)}
    if op is rc.IN and len(arg) <= 3 and all(o is rc.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is rc.SUBPATTERN:
        return _strings(arg[3], fold)
    if op is rc.BRANCH:
        parts = [_strings(b, fold) for b in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] <= 1:
        inside = _strings(arg[2], fold)
        return None if inside is None else inside | ({""} if arg[0] == 0 else set())
    return None


def _strings(seq, fold: bool) -> set[str] | None:
    out = {""}
    for node in seq:
        some = _literals(node, fold)
        if some is None:
            return None
        out = {a + b for a in out for b in some}
        if len(out) > MOST_WAYS:
            return None
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives (OR) of trigram sets (AND), over ASCII-lower-cased text; None if some match may hold no trigram."""
    runs, now = [], {""}
    # (?i:...) only widens to cases that the folded index can't tell apart
    for node in parser.parse(pattern):
        some = _literals(node, True)
        if some is None:
            runs.append(now)
            now = {""}
        else:
            now = {a + b for a in now for b in some}
            if len(now) > MOST_WAYS:
                runs.append({""})
                now = {""}
    runs.append(now)
    grams = lambda s: frozenset(s[i : i + 3] for i in range(len(s) - 2))
    options = [{grams(s) for s in run} for run in runs]
    options = [o for o in options if frozenset() not in o]
    if not options:
        return None
    ways = {frozenset().union(*x) for x in product(*options)} if len(options) <= 3 else options[0]
    # a way that holds all trigrams of another one adds nothing
    return sorted((w for w in ways if not any(v < w for v in ways)), key=sorted)


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, part>>: every match with its place; part is the length of the rule's group.

    Java tells the matches and what lies between them; lengths add up to places.
    """
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    gaps = F.split(text, rule.pattern, -1)
    zipped = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(hits, F.length).alias("hit"), F.transform(parts, F.length).alias("part"))
    length = lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0))
    # places are running sums: over groups of matches first, then within each, so that no long array is copied for each match
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.size(hits) / GROUP).cast("int")), lambda i: F.slice(zipped, i * GROUP + 1, F.lit(GROUP)))
    totals = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda a, x: a + length(x)))
    starts = F.aggregate(totals, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    none = F.array().cast("array<struct<start:int,end:int,part:int>>")

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = acc["at"] + length(x)
        here = F.array(F.struct(begin.alias("start"), end.alias("end"), x["part"].alias("part")))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], here)).alias("out"))

    of_group = lambda g, start: F.aggregate(g, F.struct(start.alias("at"), none.alias("out")), step)["out"]
    found = F.flatten(F.zip_with(groups, F.slice(starts, F.lit(1), F.size(groups)), of_group))
    return F.filter(F.when(F.size(hits) > 0, found).otherwise(none), lambda x: x["part"] >= rule.least)


def kept_pattern(rule: Rule) -> Rule:
    """A rule that is one run of a class, [..]+ with a least length: runs below it never match in the first place."""
    seq = parser.parse(rule.pattern)
    if len(seq) == 1 and seq[0][0] is rc.MAX_REPEAT and rule.group == 0 and rule.pattern.endswith("+") and rule.least > 1:
        return Rule(rule.name, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least, rule.base)
    return rule


def _key(doc_id: str, text: Column) -> list[Column]:
    return [F.col(doc_id).alias("id"), F.xxhash64(text).alias("h")]


def _folded(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def build_index(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram, id, h) of the given trigrams."""
    body = F.coalesce(F.col(text), F.lit(""))
    # the text is folded once, in a projection of its own
    rows = docs.select(*_key(doc_id, body), _folded(body).alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return rows.select("id", "h", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, rules: list[Rule], trigrams: list[str]) -> DataFrame:
    """(id, h, rules): the names of the rules whose query the document's postings satisfy."""
    code = F.array_position(F.array(*[F.lit(t) for t in trigrams]), F.col("trigram")) - 1
    masks = postings.groupBy("id", "h").agg(F.bit_or(F.expr("1L").cast("long") * F.pow(F.lit(2.0), code).cast("long")).alias("mask"))

    def satisfied(rule):
        test = F.lit(False)
        for way in trigram_query(rule.pattern):
            bits = sum(1 << trigrams.index(t) for t in way)
            test = test | (F.col("mask").bitwiseAND(F.lit(bits)) == bits)
        return test

    names = F.filter(F.array(*[F.when(satisfied(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return masks.select("id", "h", names.alias("rules")).filter(F.size("rules") > 0)


def _anchors(rules: list[Rule], counts: dict[str, int]) -> list[str]:
    """For each way of each rule, its rarest trigram: a candidate holds at least one of them."""
    return sorted({min(way, key=lambda t: (counts.get(t, 0), t)) for r in rules for way in trigram_query(r.pattern)})


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, spans) of every row; spans: array<struct<start, end, rank, kind>>, sorted by start, then by the rules' order."""
    rules = RULES if rules is None else rules
    indexed = [r for r in rules if trigram_query(r.pattern)]
    full = [r for r in rules if not trigram_query(r.pattern)]
    trigrams = sorted({t for r in indexed for way in trigram_query(r.pattern) for t in way})
    if len(trigrams) > 62:
        raise ValueError("more than 62 trigrams: give the rules in several calls")
    rank = {r.name: i for i, r in enumerate(rules)}
    body = F.coalesce(F.col(text), F.lit(""))

    def ranked(rule, found):
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rank[rule.name]).alias("rank"), F.lit(rule.name).alias("kind")))

    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string>>")
    rows = docs.select(F.col(doc_id).alias("id"), body.alias("body"))
    out = rows.select(*_key("id", F.col("body")), F.concat(none, *[ranked(r, spans(F.col("body"), kept_pattern(r))) for r in full]).alias("spans"))
    if indexed:
        postings = stored(build_index(docs, trigrams, doc_id, text), "postings")
        counts = {r.trigram: r["count"] for r in postings.groupBy("trigram").count().collect()}  # one row for each trigram of the rules
        chosen = candidates(postings, indexed, trigrams)
        low = _folded(F.col("body"))
        likely = F.lit(False)
        for t in _anchors(indexed, counts):
            likely = likely | F.contains(low, F.lit(t))
        texts = rows.filter(likely).select(*_key("id", F.col("body")), "body")
        sure = texts.join(chosen, texts["id"].eqNullSafe(chosen["id"]) & (texts["h"] == chosen["h"])).select(texts["id"], texts["h"], "body", "rules")
        found = [F.when(F.array_contains("rules", r.name), ranked(r, spans(F.col("body"), r))).otherwise(none) for r in indexed]
        verified = sure.select("id", "h", F.concat(none, *found).alias("more")).filter(F.size("more") > 0).dropDuplicates(["id", "h"])
        verified = stored(verified, "verified-spans")
        size = verified.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("more")).alias("spans")).first()
        verified = shared_if_small(verified, size.n + (size.spans or 0), 64).withColumnsRenamed({"id": "id2", "h": "h2"})
        out = out.join(verified, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
        out = out.withColumn("spans", F.concat("spans", F.coalesce("more", none)))
    bases = [i for r, i in zip(rules, range(len(rules))) if r.base]
    fixed = F.filter("spans", lambda x: x["rank"].isin(bases)) if bases else none
    extra = F.filter("spans", lambda x: ~x["rank"].isin(bases) & ~F.exists(fixed, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return out.select(F.col("id").alias("doc_id"), F.array_sort(F.concat(fixed, extra)).alias("spans"))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    base = F.filter("spans", lambda x: x["kind"].isin([r.name for r in BASE]))
    counts = [F.size(of(r.name)).cast("long").alias(f"n_{r.name}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _sql(rules: list[Rule]) -> str:
    quoted = lambda s: s.replace("'", "''")
    parts = [
        f"SELECT doc_id, {i} AS k, '{r.name}' AS kind, {r.base} AS base, {r.least} AS least, list_transform(string_split_regex(b, '{quoted(kept_pattern(r).pattern)}'), lambda x: length(x)) AS gaps, "
        f"list_transform(regexp_extract_all(b, '{quoted(kept_pattern(r).pattern)}', 0), lambda x: length(x)) AS hits, "
        f"list_transform(regexp_extract_all(b, '{quoted(kept_pattern(r).pattern)}', {r.group}), lambda x: length(x)) AS parts FROM t"
        for i, r in enumerate(rules)
    ]
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS b FROM documents),
m AS ({" UNION ALL ".join(parts)}),
u AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (SELECT doc_id, k, kind, base, parts[i] AS part, least, list_sum(gaps[1:i]) + coalesce(list_sum(hits[1:i - 1]), 0) AS a, list_sum(gaps[1:i]) + list_sum(hits[1:i]) AS z FROM u),
f AS (SELECT * FROM s WHERE part >= least),
g AS (SELECT * FROM f WHERE base OR NOT EXISTS (SELECT 1 FROM f AS o WHERE o.base AND o.doc_id = f.doc_id AND o.a < f.z AND f.a < o.z))
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
sha256(coalesce(string_agg(kind || ':' || a::BIGINT || ':' || z::BIGINT, ',' ORDER BY a, k) FILTER (base), '')) AS base_sha256,
coalesce(string_agg(kind || ':' || a::BIGINT || ':' || z::BIGINT, ',' ORDER BY a, k) FILTER (kind IS NOT NULL), '') AS spans
FROM t LEFT JOIN g ON t.doc_id = g.doc_id GROUP BY t.doc_id
"""


OP6_SQL = _sql(RULES)
