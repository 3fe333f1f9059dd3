"""Secret scans: a trigram inverted index picks candidates, the regexes verify them. DataFrame functions only.

Each rule's pattern is parsed once on the driver into a Boolean query over lower-cased trigrams. The index holds, for
blocks of documents, one posting list (document ids) per trigram that some rule asks for; a rule's query intersects
and unites posting lists inside a block, so no list grows with the corpus. Candidates are then verified on the full
text. A rule without mandatory trigrams (long hex strings) scans every text.

Defined results: a null or empty text has no spans; repeated rows (also of one doc_id) each get a row of their own;
null doc_ids are scanned as any other; an empty table gives an empty result; extra columns are ignored by
``find_secrets`` and kept by ``redact``.
"""

from __future__ import annotations

import re._parser as regex_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table


def either_case(word: str) -> str:
    """The pattern of an ASCII word in either case, spelled out so that every regex engine agrees."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """``group``'s length (0: the whole match) must reach ``least``; matches that fail are dropped, not retried."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    #: Maximal runs, so that the length in the pattern finds what [0-9a-f]+ and a later length test find.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 40, base=False),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0, base=False),
)
#: Documents whose ids share a posting block; bounds a posting list.
BLOCK_DOCS = 2048
#: Sets of alternative strings beyond these sizes count as "anything" when a query is derived.
MAX_STRINGS, MAX_CLASS = 64, 16


# A query: True (anything matches), ("tri", t), ("and", [...]) or ("or", [...]).
def _all(parts: list):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: list):
    return True if not parts or any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]):
    """Some of the strings occurs; a string that asks for all that another one asks for, and more, adds nothing."""
    asked = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [a for a in asked if not any(b < a for b in asked)]
    return _any([_all([("tri", t) for t in sorted(a)]) for a in sorted(least, key=sorted)])


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < 128:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MAX_CLASS else None


def _exact(node) -> set[str] | None:
    """The lower-cased strings that a node stands for, or None if they are unbounded or too many."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        return _class(arg)
    if op == "SUBPATTERN":
        return _exact_all(arg[3])
    if op == "BRANCH":
        sets = [_exact_all(x) for x in arg[1]]
        out = None if None in sets else set().union(*sets)
        return out if out is not None and len(out) <= MAX_STRINGS else None
    if op == "MAX_REPEAT" and arg[1] <= 4:
        one = _exact_all(arg[2])
        out = None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(sorted(one), repeat=n)}
        return out if out is not None and len(out) <= MAX_STRINGS else None
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for n in nodes:
        more = _exact(n)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(nodes):
    parts, run = [], {""}
    for node in nodes:
        strings = _exact(node)
        if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        parts.append(_of_strings(run))
        run = {""} if strings is None else strings
        op, arg = str(node[0]), node[1]
        if strings is None and op == "SUBPATTERN":
            parts.append(_query(arg[3]))
        elif strings is None and op == "BRANCH":
            parts.append(_any([_query(x) for x in arg[1]]))
        elif strings is None and op == "MAX_REPEAT" and arg[0] > 0:
            parts.append(_query(arg[2]))
    return _all([*parts, _of_strings(run)])


def trigram_query(pattern: str):
    """A Boolean query over lower-cased trigrams that holds for every text with a match."""
    return _query(regex_parser.parse(pattern))


def _trigrams(query) -> set[str]:
    return set() if query is True else {query[1]} if query[0] == "tri" else set().union(*map(_trigrams, query[1]))


def postings(docs: DataFrame, trigrams: list[str], blocks: int) -> DataFrame:
    """(block, trigram, ids): the documents of each block whose lower-cased text holds the trigram."""
    rows = docs.select("doc_id", F.lower("text").alias("__low")).where(F.col("__low").isNotNull())
    held = F.array_compact(F.array(*[F.when(F.contains("__low", F.lit(t)), F.lit(t)) for t in trigrams]))
    rows = rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), held.alias("held"))
    rows = rows.where(F.size("held") > 0).select("block", "doc_id", F.explode("held").alias("trigram"))
    return rows.repartition("block").groupBy("block", "trigram").agg(F.collect_set(F.struct("doc_id")).alias("ids"))


def _matching(query, lists: Column, empty: Column) -> Column:
    if query[0] == "tri":
        return F.coalesce(lists[query[1]], empty)
    out, *rest = [_matching(q, lists, empty) for q in query[1]]
    for r in rest:
        out = F.array_intersect(out, r) if query[0] == "and" else F.array_union(out, r)
    return out


def candidates(index: DataFrame, queries: dict[int, object]) -> DataFrame:
    """(doc_id, rules): bit i is set where rule i's query holds."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
    empty = F.filter(F.element_at(F.map_values("lists"), 1), lambda x: F.lit(False))

    def marked(i: int) -> Column:
        return F.transform(_matching(queries[i], F.col("lists"), empty), lambda x: F.struct(x["doc_id"].alias("doc_id"), F.lit(1 << i).alias("bit")))

    found = [marked(i) for i in queries]
    return blocks.select(F.explode(F.concat(*found)).alias("x")).groupBy(F.col("x.doc_id").alias("__cand")).agg(F.bit_or("x.bit").alias("__rules"))


def _sums(values: Column) -> Column:
    """Running sums of an int array in blocks, so that a text with many matches stays far from quadratic."""
    n = 128

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def run(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / n).cast("int")), lambda b: total(F.slice(a, b * n + 1, n)))
        before = let(blocks, lambda t: F.transform(t, lambda _, i: total(F.slice(t, 1, i))))
        return let(before, lambda t: F.transform(a, lambda _, i: F.get(t, F.floor(i / n).cast("int")) + total(F.slice(a, F.floor(i / n).cast("int") * n + 1, i % n + 1))))

    return F.when(F.size(values) == 0, values).otherwise(let(values, run))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind, end>> of a rule's matches: what lies between matches gives their places."""
    pattern = F.lit(rule.pattern)
    lengths = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    judged = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m) >= rule.least)
    between = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))

    def place(m: Column) -> Column:
        ends = _sums(F.zip_with(F.slice(between, 1, F.size(m)), m, lambda a, b: a + b))
        rows = F.transform(F.arrays_zip(ends.alias("e"), m.alias("n"), judged.alias("ok")), lambda x: F.struct((x["e"] - x["n"]).alias("start"), F.lit(order).alias("kind"), x["e"].alias("end"), x["ok"].alias("ok")))
        return F.transform(F.filter(rows, lambda x: x["ok"]), lambda x: F.struct(x["start"], x["kind"], x["end"]))

    return let(lengths, place)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def scan(docs: DataFrame, carried: Column, rules=RULES) -> DataFrame:
    """row (what is carried), t (text, null as empty) and s: all spans as array<struct<start, kind, end>>, in order."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True}
    rows = docs.select(carried.alias("row"), F.coalesce("text", F.lit("")).alias("t"), F.col("doc_id").alias("id"))
    if queries:
        blocks = max(1, -(-docs.count() // BLOCK_DOCS))
        vocabulary = sorted(set().union(*map(_trigrams, queries.values())))
        cand = candidates(postings(docs.select("doc_id", "text"), vocabulary, blocks), queries)
        rows = rows.join(cand, F.col("id").eqNullSafe(F.col("__cand")), "left")
    else:
        rows = rows.withColumn("__rules", F.lit(0))
    asked = F.coalesce("__rules", F.lit(0))
    per_rule = []
    for i, r in enumerate(rules):
        hit = (asked.bitwiseAND(1 << i) != 0) if i in queries else F.col("t").rlike(r.pattern)
        per_rule.append(F.when(hit, _spans(F.col("t"), r, i)).otherwise(_none()))
    return rows.select("row", "t", F.array_sort(F.concat(*per_rule)).alias("s"))


def _joined(spans: Column, rules) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row a document: matches of each base rule, all spans, and a digest of the base rules' spans."""
    base = [i for i, r in enumerate(rules) if r.base]
    s = F.col("s")

    def of_kind(i: int) -> Column:
        return F.filter(s, lambda x: x["kind"] == i)

    return scan(docs, F.col("doc_id"), rules).select(
        F.col("row").alias("doc_id"),
        *[F.size(of_kind(i)).cast("long").alias(f"n_{rules[i].kind}") for i in base],
        F.sha2(_joined(F.filter(s, lambda x: x["kind"].isin(base)), rules), 256).alias("base_sha256"),
        _joined(s, rules).alias("spans"),
    )


def redact(docs: DataFrame, rules=RULES, mark: str = "<secret>") -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans are replaced as one."""
    scanned = scan(docs, F.struct("*"), rules)

    def widened(acc: Column, x: Column) -> Column:
        gap = F.array(F.struct(acc["reach"].alias("a"), x["start"].alias("b")))
        gaps = F.when(x["start"] >= acc["reach"], F.concat(acc["gaps"], gap)).otherwise(acc["gaps"])
        return F.struct(F.greatest(acc["reach"], x["end"]).alias("reach"), gaps.alias("gaps"))

    def rebuilt(acc: Column) -> Column:
        between = F.transform(acc["gaps"], lambda g: F.substring(F.col("t"), g["a"] + 1, g["b"] - g["a"]))
        return F.array_join(F.concat(between, F.array(F.substring(F.col("t"), acc["reach"] + 1, F.length("t")))), mark)

    none = F.struct(F.lit(0).alias("reach"), F.array().cast("array<struct<a:int,b:int>>").alias("gaps"))
    text = F.when(F.size("s") > 0, F.aggregate("s", none, widened, rebuilt)).otherwise(F.col("row.text"))
    return scanned.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def _oracle_rule(i: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return (
        f"SELECT r, {i} AS kind, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(regexp_extract_all(t, '{p}', {rule.group})) AS g, "
        f"unnest(regexp_split_to_array(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS b, {rule.least} AS least, "
        f"unnest(range(len(regexp_extract_all(t, '{p}')))) AS i FROM d"
    )


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(_oracle_rule(i, r) for i, r in enumerate(RULES))}),
pos AS (SELECT r, kind, length(m) AS n, length(g) >= least AS ok, CAST(sum(length(b) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS e FROM raw),
sp AS (SELECT r, kind, e - n AS s, [{", ".join(f"'{r.kind}'" for r in RULES)}][kind + 1] || ':' || (e - n) || ':' || e AS x FROM pos WHERE ok),
a AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{r.kind}" for i, r in enumerate(RULES) if r.base)},
  string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < {sum(r.base for r in RULES)}) AS base, string_agg(x, ',' ORDER BY s, kind) AS spans FROM sp GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""
