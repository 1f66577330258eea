"""The registered queries of this subpackage and the SQL that their results are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hairpin.llm import bm25_packing, bpe, class_lm, embedding_dedup, filter_audit, jaccard_join, language_id, merkle, quality_classifier, quality_rules, range_coder, suffix_dedup, warc
from hairpin.llm.batches import documents

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "margin", "accepted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality_rules.annotate(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(documents(spark, sf_dir))


def op4_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_packing.pack(documents(spark, sf_dir), tokenizer_path(BYTE_BPE))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path(WORD_BPE))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_classifier.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_coder.round_trip(documents(spark, sf_dir), tokenizer_path(WORD_BPE))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return filter_audit.audit(documents(spark, sf_dir), labels)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


def _op6_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    ratio = {
        "n_words": "n_words",
        "mean_word_chars": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END",
        "symbol_ratio": "CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END",
        "stop_word_ratio": "CASE WHEN n_words > 0 THEN (n_stop + 1) / n_words ELSE 0 END",
        "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
    }
    tests = [f"{ratio[k]} >= {a}" for k, (a, _) in quality_rules.RULES.items() if a is not None] + [f"{ratio[k]} <= {b}" for k, (_, b) in quality_rules.RULES.items() if b is not None]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {space}, '')) > 0) AS ls FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM dup WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(t, {space}, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept FROM f"""


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to FROM f"""

OP12_SQL = """
WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT documents.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
      FROM documents LEFT JOIN l ON documents.doc_id = l.doc_id),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
m AS (SELECT part, good, toxic, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
             100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t),
             regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM w),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
k AS (SELECT unnest(range(1, 6)) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS p, list_reduce(list_transform([a.f, b.f, c.f, d.f, e.f], lambda x: chr(CAST(64 + x AS INTEGER))), lambda x, y: x || y) AS filter_order
      FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT part, filter_order, i AS step, p[i] AS f, fails, n, good, toxic, fails[p[i]] AS hit, list_bool_or(list_transform(range(1, i), lambda j: fails[p[j]])) AS before
      FROM g, o, (SELECT unnest(range(1, 6)) AS i)),
c AS (SELECT part, filter_order, step, f,
        sum(n) FILTER (NOT hit AND NOT coalesce(before, false)) AS kept, sum(n) FILTER (hit AND NOT coalesce(before, false)) AS removed, sum(n) FILTER (hit AND coalesce(before, false)) AS redundant,
        sum(n) FILTER (hit AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
        sum(good) FILTER (hit AND NOT coalesce(before, false)) AS good_lost, sum(toxic) FILTER (hit AND NOT coalesce(before, false)) AS toxic_lost
      FROM s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM c"""

#: Levels of each tree in the SQL: 16 to this power rows a source.
_SQL_LEVELS = 7


def _op13_sql() -> str:
    frame = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(frame(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {frame(text)})"
    lower = f"translate(text, '{merkle._UPPER}', '{merkle._LOWER}')"
    # crc32 of the digits, bit by bit
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT)] || [0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    parts = [
        f"""l AS (SELECT doc_id, source, coalesce(':' || source, '-') AS k, {leaf("text")} AS leaf,
             CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS now FROM documents)""",
        "a0 AS (SELECT k AS g, doc_id, leaf AS h, row_number() OVER (PARTITION BY k ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM l)",
    ]
    up = lambda t, x, i: f"""{t}{i + 1} AS (SELECT g, i // 16 AS i, (max(n) + 15) // 16 AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {x} GROUP BY g, i // 16)"""
    for t in "ab":
        if t == "b":
            parts.append(f"b0 AS (SELECT '' AS g, g AS k, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a{_SQL_LEVELS})")
        parts += [up(t, f"{t}{i}", i) for i in range(_SQL_LEVELS)]
    # siblings of each node, and of its ancestors
    sides = "coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo, coalesce(string_agg(h, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi"
    for t in "ab":
        parts += [f"{t}s{i} AS (SELECT g, i, n, {sides} FROM {t}{i})" for i in range(_SQL_LEVELS)]
    parts.append("r0 AS (SELECT l.doc_id, l.leaf, l.now, l.k, row_number() OVER (PARTITION BY l.k ORDER BY l.doc_id, l.leaf) - 1 AS i FROM l)")
    parts.append(f"t AS (SELECT b0.k, b0.i, b0.h AS subroot, r.h AS root FROM b0, b{_SQL_LEVELS} r)")
    shift = [f"CAST(16 AS BIGINT) ** {i}" for i in range(_SQL_LEVELS)]
    joins = "".join(f" JOIN as{i} ON as{i}.g = r0.k AND as{i}.i = r0.i // CAST({s} AS BIGINT)" for i, s in enumerate(shift)) + " JOIN t ON t.k = r0.k"
    joins += "".join(f" JOIN bs{i} ON bs{i}.i = t.i // CAST({s} AS BIGINT)" for i, s in enumerate(shift))
    all_levels = [f"{t}s{i}" for t in "ab" for i in range(_SQL_LEVELS)]
    lists = ", ".join(f"{{'lo': {x}.lo, 'hi': {x}.hi, 'n': {x}.n, 'h': ''}}" for x in all_levels)
    parts.append(f"j AS (SELECT r0.doc_id, r0.leaf, t.subroot, t.root, list_filter([{lists}], lambda x: x.n > 1) AS p, r0.now FROM r0{joins})")
    fold = "list_reduce(list_prepend({'lo': '', 'hi': '', 'n': CAST(0 AS BIGINT), 'h': now}, p), lambda a, x: {'lo': '', 'hi': '', 'n': CAST(0 AS BIGINT), 'h': sha256(x.lo || a.h || x.hi)}).h"
    proof = "sha256(coalesce(list_reduce(list_transform(p, lambda x: x.lo || x.hi), lambda a, b: a || b), ''))"
    parts.append(f"f AS (SELECT doc_id, leaf, subroot, root, CASE WHEN len(p) = 0 THEN sha256('') ELSE {proof} END AS proof_sha256, {fold} AS folded_root FROM j)")
    return f"WITH {', '.join(parts)} SELECT *, folded_root = root AS verified FROM f"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_language_id": op2_language_id,
        "op3_class_lm": op3_class_lm,
        "op4_bm25_packing": op4_bm25_packing,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_quality_rules": op6_quality_rules,
        "op7_bpe": op7_bpe,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_range_coder": op10_range_coder,
        "op11_warc": op11_warc,
        "op12_filter_audit": op12_filter_audit,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": _op6_sql(), "op11_warc": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_merkle": _op13_sql()}
