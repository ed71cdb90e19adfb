"""Queries over the driver's tables, one per operator of this subpackage; each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), 0.98)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


_OP2_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS x
      FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM d WHERE len(lines) >= 3)
      WHERE trim(lines[pos + 1] || lines[pos + 2] || lines[pos + 3]) <> ''
      UNION ALL SELECT doc_id, 0 AS pos, 'short' || chr(10) || text AS x FROM d WHERE len(lines) < 3 AND trim(replace(text, chr(10), '')) <> ''),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY x ORDER BY doc_id, pos) AS n FROM w),
gone AS (SELECT DISTINCT doc_id, pos + k AS line FROM r, (SELECT unnest(range(0, 3)) AS k) WHERE n > 1),
l AS (SELECT doc_id, i, lines[i + 1] AS line FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM d)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text, count(*) AS n FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line = l.i WHERE gone.line IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(d.lines), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_conversations

    extra = spark.sql(r"""SELECT -7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)""")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_conversations(rows))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"), (5, 2, 1)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of operator 4's rows: sizes and targets."""
    return op4_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import labelled_findings, lexicon, scan, train

    documents = _table(spark, sf_dir, "documents")
    words = lexicon(documents)
    return scan(documents, train(labelled_findings(spark, words), words), words)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import overlaps

    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_output

    return token_output(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": op1_embedding_near_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_chat_format": op3_chat_format,
        "op4_mix_sources": op4_mix_sources,
        "mix_targets": mix_targets,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_secret_scan": op6_secret_scan,
        "op7_warc": op7_warc,
        "op8_decontaminate": op8_decontaminate,
        "op9_token_output": op9_token_output,
        "op10_language_id": op10_language_id,
    }


# Links by brute force; each vector is a row of its own, named by its place.
_OP1_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.i AS a, b.i AS b FROM ok a JOIN ok b ON a.label = b.label AND a.i <> b.i AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT i, i FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a AS i, min(v.vec_id) AS component_id FROM reach JOIN v ON v.i = reach.b GROUP BY reach.a),
many AS (SELECT a AS i, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(many.n, 0) AS BIGINT) AS n_links, least.component_id, v.vec_id IS NOT DISTINCT FROM least.component_id AS kept
FROM v JOIN least ON least.i = v.i LEFT JOIN many ON many.i = v.i
"""

# formatted_chars by counting: marks of the template, percent signs of roles, and what escaping adds where a text holds a control string.
_OP3_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, len(regexp_extract_all(text, '\[/?INST|\[OUT\]|</s>|<s:')) AS controls, length(text) - length(replace(text, chr(92), '')) AS slashes FROM c),
e AS (SELECT conv_id, bool_or(controls > 0) AS escaped FROM t GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(5 + sum(length(text) + CASE WHEN role = 'assistant' THEN 10 ELSE 15 + length(replace(url_encode(role), '%20', '+')) END + CASE WHEN escaped THEN controls + slashes ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t JOIN e USING (conv_id) GROUP BY conv_id
"""

# Sources in the order of the share at which they are full: one is capped if what is left for it and those after it fills it.
_TARGETS_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5::DOUBLE, 2::DOUBLE, 1::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight, source_size * 3::DOUBLE AS most FROM p),
c AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER v, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER v, 0)) >= most / weight AS capped FROM w
      WINDOW v AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT (CAST(sum(source_size) AS DOUBLE) - coalesce(sum(most) FILTER (capped), 0)) / (sum(weight) FILTER (NOT capped)) AS share FROM c)
SELECT s.doc_id, s.size, c.source_size, CASE WHEN capped THEN most ELSE weight * share END AS target FROM s JOIN c ON s.source IS NOT DISTINCT FROM c.source CROSS JOIN f
"""

_OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS x FROM d),
n AS (SELECT doc_id, len(x) AS n_shingles FROM s),
r AS (SELECT doc_id, unnest(x) AS t FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.t = b.t AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          WHERE 10 * na.n_shingles >= 9 * nb.n_shingles AND 10 * nb.n_shingles >= 9 * na.n_shingles
          GROUP BY a.doc_id, b.doc_id, na.n_shingles, nb.n_shingles HAVING 100 * count(*) >= 90 * (na.n_shingles + nb.n_shingles - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT n.doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n_shingles
"""

# Base 32 of a SHA-1: 20 bits of the hex digest are four digits.
_OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": _OP1_SQL, "op2_line_dedup": _OP2_SQL, "op3_chat_format": _OP3_SQL, "mix_targets": _TARGETS_SQL, "op5_jaccard_join": _OP5_SQL, "op7_warc": _OP7_SQL}
