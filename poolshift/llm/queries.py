"""Registered queries of this folder: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, decontam, lm_score, merkle, mixing, ngram_join, pii, quality, rtree, shards, substrings, topk, toxicity
from .text import table


def op1_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op2_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_cross_entropy_difference(spark, sf_dir):
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.score_documents(table(spark, sf_dir, "documents"), target)


def op5_byte_bpe(spark, sf_dir):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_personal_data(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark, sf_dir):
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.array_join("items", ",").alias("leaked_items"), "coverage",
                        (F.size("items") > 0).cast("int").alias("contaminated"))


def op8_histogram_shards(spark, sf_dir):
    return (shards.shard_documents(table(spark, sf_dir, "documents"), 8)
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))


def op9_quality_classifier(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_repeated_spans(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    noised = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return rtree.hard_negatives(noised, noised.where("vec_id % 100 = 0"), positives=5, k=10, least=30, most=90)


def op12_source_mix(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_merkle_manifest(spark, sf_dir):
    checked = merkle.verify(merkle.manifest(table(spark, sf_dir, "documents")))
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {f.__name__: f for f in (
    op1_exact_top_k, op2_ngram_jaccard_join, op3_toxicity, op4_cross_entropy_difference, op5_byte_bpe,
    op6_personal_data, op7_benchmark_decontamination, op8_histogram_shards, op9_quality_classifier,
    op10_repeated_spans, op11_hard_negatives, op12_source_mix, op13_merkle_manifest)}
#: DuckDB: lower-case A-Z and the words of a text.
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: CRC-32 of the decimal digits of doc_id, bit by bit.
_CRC_ID = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda ch: list_transform(range(8), lambda b: CAST((ascii(ch) >> CAST(b AS INTEGER)) & 1 AS BIGINT))))),
    lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)))"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


def _leaf(text: str) -> str:
    columns = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(_field(c) for c in columns) + ")"


def _merkle_sql(depth: int = 6) -> str:
    """One CTE a level; ``depth`` levels hold 16 ** depth leaves of a source, and as many sources."""
    ctes = [f"""l AS (SELECT doc_id, source, {_leaf("text")} AS h, CASE WHEN {_CRC_ID} % 5 = 0
                THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents)""",
            """s0 AS (SELECT row_number() OVER () AS id, doc_id, changed, source, h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS j,
                count(*) OVER (PARTITION BY source) AS n FROM l)"""]

    def climb(name: str, tree: str):
        for d in range(depth):
            at = f"PARTITION BY {tree}, j // 16 ORDER BY j ROWS BETWEEN"
            ctes.append(f"""{name}_in{d} AS (SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({at} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS lefts,
                CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({at} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS rights FROM {name}{d})""")
            ctes.append(f"""{name}{d + 1} AS (SELECT {tree}, j // 16 AS j, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY j)) ELSE any_value(h) END AS h,
                (max(n) + 15) // 16 AS n FROM {name}{d} GROUP BY {tree}, j // 16)""")

    climb("s", "source")
    ctes.append(f"t0 AS (SELECT 0 AS top, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j, count(*) OVER () AS n FROM s{depth})")
    climb("t", "top")
    steps = [(f"a{d}", d) for d in range(depth)] + [(f"b{d}", d) for d in range(depth)]
    joins = [f"LEFT JOIN s_in{d} a{d} ON a{d}.source IS NOT DISTINCT FROM a0.source AND a{d}.j = a0.j // {16 ** d}" for d in range(1, depth)]
    joins += ["JOIN t_in0 b0 ON b0.source IS NOT DISTINCT FROM a0.source"]
    joins += [f"LEFT JOIN t_in{d} b{d} ON b{d}.j = b0.j // {16 ** d}" for d in range(1, depth)]
    proof = " || ".join(f"coalesce({a}.lefts || {a}.rights, '')" for a, _ in steps)
    folds, last = [], "coalesce(changed, leaf)"
    for i, (a, _) in enumerate(steps):
        folds.append(f"f{i} AS (SELECT *, CASE WHEN {a}_l IS NULL THEN {last} ELSE sha256({a}_l || {last} || {a}_r) END AS f{i} FROM {'p' if not i else f'f{i - 1}'})")
        last = f"f{i}"
    sides = ", ".join(f"{a}.lefts AS {a}_l, {a}.rights AS {a}_r" for a, _ in steps)
    ctes.append(f"""p AS (SELECT a0.doc_id, a0.h AS leaf, a0.changed, b0.h AS subroot, r.h AS root, sha256({proof}) AS proof_sha256, {sides}
        FROM s_in0 a0 {' '.join(joins)} CROSS JOIN t{depth} r)""")
    return f"WITH {', '.join(ctes + folds)} SELECT doc_id, leaf, subroot, root, proof_sha256, {last} AS folded_root, {last} = root AS verified FROM {last}"


ORACLE: dict[str, str] = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op2_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
            FROM w),
        sizes AS (SELECT doc_id, len(g) AS n FROM s),
        grams AS (SELECT doc_id, unnest(g) AS gram FROM s),
        common AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * c >= 75 * (p.n + q.n - c)),
        reach AS (
            SELECT doc_id, doc_id AS other FROM sizes
            UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
        SELECT s.doc_id, CAST(any_value(s.n) AS BIGINT) AS n_shingles, min(r.other) AS component_id
        FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id""",
    "op10_repeated_spans": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
        starts AS (
            SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS words
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
        least AS (SELECT words, min(doc_id) AS least FROM starts GROUP BY words HAVING min(doc_id) < max(doc_id)),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i
            FROM starts JOIN least USING (words) WHERE least < doc_id),
        dropped AS (SELECT doc_id, count(*) AS n, list(i) AS at FROM gone GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(d.n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(CASE WHEN d.n IS NULL THEN w.w ELSE
                   list_transform(list_filter(range(1, len(w.w) + 1), lambda i: NOT list_contains(d.at, i)), lambda i: w.w[i]) END, ' '), '')) AS kept_sha256
        FROM w LEFT JOIN dropped d ON d.doc_id = w.doc_id""",
    "op11_hard_negatives": """
        WITH v AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
               other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10""",
    "op12_source_mix": f"""
        WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format(text="coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
        laid AS (
            SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id NULLS FIRST, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
        prefixes AS (
            SELECT 3 * source_size AS cap, weight, 3 * source_size / weight AS ratio FROM w),
        cuts AS (
            SELECT coalesce(sum(cap) OVER before, 0) AS capped, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0) AS free
            FROM prefixes WINDOW before AS (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        level AS (SELECT max(CAST((SELECT sum(source_size) FROM s) - capped AS DOUBLE) / CAST(free AS DOUBLE)) AS share FROM cuts),
        t AS (SELECT source, source_size, least(share * weight, 3.0::DOUBLE * source_size) AS target FROM w, level),
        x AS (
            SELECT doc_id, size, t.source_size, target, before, least(CAST(floor(target + 0.5) AS BIGINT), 3 * t.source_size) AS want
            FROM laid JOIN t ON laid.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(CASE WHEN size = 0 THEN 0 ELSE want // source_size * size + greatest(0, least(size, want % source_size - before)) END AS BIGINT) AS taken
        FROM x""",
    "op13_merkle_manifest": _merkle_sql(),
}
