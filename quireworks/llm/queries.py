"""The operators' queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    from .pieces import digests, encode_pieces

    return digests(encode_pieces(_table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model")))


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from .jaccard import classes

    return classes(_table(spark, folder, "documents"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(_table(spark, folder, "pages"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op5_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    from .passages import repeated_passages

    return repeated_passages(_table(spark, folder, "documents"))


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from .neighbours import search

    return search(_table(spark, folder, "embeddings"), every=50, k=5)


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from .prefixes import count_tokens

    return count_tokens(_table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    from .ctw import score

    return score(_table(spark, folder, "documents"))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from .rans import token_files

    return token_files(_table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, folder, "documents"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    from .variants import group_variants

    return group_variants(_table(spark, folder, "documents"))


def op13_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    from .secrets import digests, find_secrets

    return digests(find_secrets(_table(spark, folder, "documents")))


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_neighbours": op6_neighbours,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_context_tree": op9_context_tree,
    "op10_token_files": op10_token_files,
    "op11_collocations": op11_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_secret_scans": op13_secret_scans,
}

ORACLES: dict[str, str] = {
    "op2_jaccard_join": """
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
        reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x),
        least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
        SELECT l.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id FROM least l LEFT JOIN n ON n.doc_id = l.doc_id""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
        FROM g""",
    "op11_collocations": """
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
        sizes AS (SELECT unnest([1, 2, 3, 4]) AS size),
        f AS (
          SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - size + 2), lambda i: w[i:i + size - 1])) AS w
            FROM pieces, sizes WHERE len(w) >= size) GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT lang, w, f AS a FROM f WHERE len(w) > 1),
        cuts AS (
          SELECT c.lang, c.w, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
          FROM (SELECT *, unnest(range(1, len(w))) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.w = c.w[1:k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k + 1:]),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
        parts AS (
          SELECT lang, w[i:i + size - 1] AS w, max(a) AS most FROM (SELECT c.lang, c.w, c.a, size, unnest(range(1, len(c.w) - size + 2)) AS i
            FROM c, sizes WHERE size > 1 AND size < len(c.w)) GROUP BY ALL),
        kept AS (
          SELECT b.*, array_to_string(b.w, ' ') AS phrase FROM best b LEFT JOIN parts p ON p.lang = b.lang AND p.w = b.w
          WHERE p.most IS NULL OR 100::HUGEINT * p.most < 80::HUGEINT * b.a)
        SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= 2000""",
    "op12_spelling_variants": """
        WITH RECURSIVE crcs AS (
          SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b::UBIGINT, range(0, 8)::UBIGINT[]),
            lambda x, i: CASE WHEN x & 1 = 1 THEN xor(3988292384::UBIGINT, x >> 1) ELSE x >> 1 END)) AS t),
        runs AS (
          SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]{5,}')) AS run FROM documents) GROUP BY ALL),
        bytes AS (
          SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
            lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))::UBIGINT[] AS b FROM runs),
        hashed AS (
          SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda x, y: xor(t[(xor(x, y) & 255)::BIGINT + 1], x >> 8)), 4294967295::UBIGINT) AS h
          FROM bytes, crcs),
        v AS (
          SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
            ELSE run END AS word FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        gone AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, unnest(range(0, length(word))) AS i FROM v)),
        pairs AS (
          SELECT word AS a, less AS b FROM gone WHERE less IN (SELECT word FROM v)
          UNION SELECT less, word FROM gone WHERE less IN (SELECT word FROM v)
          UNION SELECT x.word, y.word FROM gone x JOIN gone y ON x.less = y.less AND x.i = y.i AND x.word <> y.word),
        near AS (
          SELECT a AS word, count(*) AS n_near, max(y.n) AS most, min_by(b, (-y.n, b)) AS best
          FROM pairs JOIN v y ON y.word = b GROUP BY a),
        forms AS (
          SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN best END AS form, CASE WHEN most >= 2 * v.n THEN most END AS form_n
          FROM v LEFT JOIN near ON near.word = v.word),
        chain AS (SELECT word, word AS here FROM v UNION ALL SELECT chain.word, form FROM chain JOIN forms ON forms.word = chain.here WHERE form IS NOT NULL)
        SELECT f.word, form, here AS root, n, n_near, form_n
        FROM forms f JOIN chain c ON c.word = f.word JOIN (SELECT word AS w FROM forms WHERE form IS NULL) last ON last.w = c.here""",
}
