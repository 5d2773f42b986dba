"""Secret scans over a trigram inverted index, in DataFrame operations only.

1. Index: one posting (trigram, document) for each trigram that some rule names
   and that occurs in the lower-cased text. Other trigrams can't decide anything
   and are not posted.
2. Query: the postings of a document are intersected as each rule's Boolean
   trigram query demands; the result names candidate rules by document.
3. Verify: candidate rules run on the whole text. Rules without mandatory
   trigrams (long hex runs) run on every text.

Postings stay rows keyed by document, never lists keyed by trigram, so a
trigram that occurs in a third of all documents is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyrocline.llm.common import small_enough
from pyrocline.llm.secret_rules import BASE_KINDS, RULES, Query, Rule, check_rule, trigram_query, trigrams_of
from pyrocline.storage import settle


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``trigram, doc_id, text_hash``: which of the rules' trigrams occur in which text."""
    grams = sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))
    rows = docs.select("doc_id", F.xxhash64(_text()).alias("text_hash"), F.lower(_text()).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    return rows.select(F.explode(found).alias("trigram"), "doc_id", "text_hash")


def _holds(query: Query, grams: str) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(F.col(grams), query)
    parts = [_holds(x, grams) for x in sorted(query[1], key=str)]  # type: ignore[index]
    out = parts[0]
    for part in parts[1:]:
        out = out & part if query[0] == "and" else out | part  # type: ignore[index]
    return out


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, text_hash, kinds``: rules whose trigram query the document's postings meet."""
    named = [(r, q) for r in rules if (q := trigram_query(r.pattern)) is not True]
    of_doc = index.groupBy("doc_id", "text_hash").agg(F.collect_set("trigram").alias("grams"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, "grams"), F.lit(r.kind)) for r, q in named])) if named else F.array().cast("array<string>")
    return of_doc.select("doc_id", "text_hash", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(rule: Rule, order: int) -> str:
    """SQL for the spans of ``rule`` in ``t``: what lies between matches and the matches themselves give positions."""
    p = "r'" + rule.pattern.replace("'", "\\x27") + "'"
    whole, kept = f"regexp_extract_all(t, {p}, 0)", f"regexp_extract_all(t, {p}, {rule.group})"
    starts = (f"aggregate(zip_with(split(t, {p}, -1), {whole}, (a, b) -> named_struct('gap', length(a), 'len', length(b))), "
              "named_struct('at', 0, 'all', cast(array() AS array<struct<s:int,e:int>>)), (acc, x) -> named_struct("
              "'at', acc.at + x.gap + coalesce(x.len, 0), 'all', IF(x.len IS NULL, acc.all, acc.all || array(named_struct('s', acc.at + x.gap, 'e', acc.at + x.gap + x.len)))), acc -> acc.all)")
    return (f"transform(filter(zip_with({starts}, {kept}, (a, b) -> named_struct('s', a.s, 'k', {order}, 'e', a.e, 'n', length(b))), "
            f"x -> x.n >= {rule.least}), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))")


_NONE = "cast(array() AS array<struct<s:int,k:int,e:int>>)"


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans``: for each row of ``docs`` its secrets as array of (s, k, e): start, index of the rule, end.

    Positions are code points, ends exclusive; matches of one rule don't overlap,
    those of several may. Sorted by start, then rule. Null and empty texts have
    no spans; a null id is kept; repeated rows give repeated rows; an empty table
    gives an empty result. Only ``doc_id`` and ``text`` are read.
    """
    for rule in rules:
        check_rule(rule)
    found = settle(candidates(postings(docs, rules), rules), "candidates")
    found = F.broadcast(found) if small_enough(found) else found
    rows = docs.select("doc_id", _text().alias("t"), F.xxhash64(_text()).alias("text_hash"))
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_hash") == F.col("c.text_hash"))
    joined = rows.alias("d").join(found.alias("c"), same, "left").select("d.doc_id", "d.t", "c.kinds")
    parts = []
    for order, rule in enumerate(rules):
        wanted = f"array_contains(kinds, '{rule.kind}')" if trigram_query(rule.pattern) is not True else "t rlike r'" + rule.pattern.replace("'", "\\x27") + "'"
        parts.append(f"CASE WHEN {wanted} THEN {_spans(rule, order)} ELSE {_NONE} END")
    return joined.select("doc_id", F.expr(f"array_sort(concat({', '.join(parts)}))").alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, their digest and all spans as text, from :func:`scan_secrets`."""
    names = "array(" + ", ".join(f"'{r.kind}'" for r in rules) + ")"
    listed = f"array_join(transform({{}}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"
    base = [i for i, r in enumerate(rules) if r.kind in BASE_KINDS]
    counts = [F.expr(f"cast(size(filter(spans, x -> x.k = {i})) AS bigint)").alias(f"n_{rules[i].kind}") for i in base]
    of_base = listed.format(f"filter(spans, x -> x.k IN ({', '.join(map(str, base))}))")
    return found.select("doc_id", *counts, F.sha2(F.expr(of_base), 256).alias("base_sha256"), F.expr(listed.format("spans")).alias("spans"))


def digest_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for ``digest(scan_secrets(documents))``, without an index."""
    parts = []
    for order, rule in enumerate(rules):
        p = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(f"""
    SELECT i, {order} AS k, unnest(list_transform(m, lambda x, n: {{'s': list_sum(list_transform(g[1:n], lambda y: length(y)))
               + coalesce(list_sum(list_transform(m[1:n-1], lambda y: length(y))), 0), 'l': length(x), 'n': length(v[n])}})) AS u
    FROM (SELECT i, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {rule.group}) AS v FROM d WHERE regexp_matches(t, {p}))""")
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(rules))
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    base = ", ".join(str(i) for i, r in enumerate(rules) if r.kind in BASE_KINDS)
    counts = ",\n  ".join(f"count(k) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(rules) if r.kind in BASE_KINDS)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
s AS (SELECT i, k, u.s AS s, u.s + u.l AS e, concat({kinds}[k + 1], ':', cast(u.s AS BIGINT), ':', cast(u.s + u.l AS BIGINT)) AS w
      FROM f WHERE u.n >= CASE k {least} END)
SELECT any_value(d.doc_id) AS doc_id, {counts},
  sha256(coalesce(string_agg(w, ',' ORDER BY s, k) FILTER (k IN ({base})), '')) AS base_sha256,
  coalesce(string_agg(w, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN s ON d.i = s.i GROUP BY d.i"""
