"""Registered queries of the document operators, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import dedup, idfile, jaccard, langid, mixing, packing, periods, phrases, pii, repeats, tokens, topk, toxicity
from barloom.llm.common import held_out

#: Key of the pseudonyms in the registered query; a deployment passes its own.
QUERY_KEY = "public test key"


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file, on the driver and the executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels, use=~held_out(0, 5))
    return toxicity.score(docs, model).select("doc_id", held_out(0, 5).alias("held_out"), "score", "predicted", "threshold", "flagged")


def op3_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.llm.common import word_count

    docs = documents(spark, sf).select("doc_id", "source", word_count("text").alias("words"))
    return mixing.mix(docs, size=docs["words"]).select("row.doc_id", "size", "source_size", "target", "taken")


def op4_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return pii.pseudonymise(docs, QUERY_KEY)


def op5_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf), width=4, percent=85)


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.cut_documents(documents(spark, sf), tokenizer("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf).select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def op8_id_files(spark: SparkSession, sf: str) -> DataFrame:
    path = idfile.write_ids(documents(spark, sf), idfile.scratch(spark), tokenizer("word_bpe_49k.json"))
    return idfile.read_ids(spark, path, with_ids=False).drop("ids")


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    model = langid.train(docs, use=~held_out(2, 4))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score", "rejected")


def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.decisions(documents(spark, sf))


def repeated_reading(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's reading: of a tenth of the ids the words from one place on repeat a first few of them."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periods.periodic_runs(documents(spark, sf).select("doc_id", "text"), reading=repeated_reading)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("best", periods.strongest("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf))


def op13_repeated_bytes(spark: SparkSession, sf: str) -> DataFrame:
    left = repeats.without_repeats(documents(spark, sf).select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_toxicity, op3_mix_sources, op4_pseudonyms, op5_ngram_jaccard, op6_packing,
                                   op7_token_counts, op8_id_files, op9_language, op10_exact_dedup, op11_periodic_runs, op12_collocations,
                                   op13_repeated_bytes, pipeline)}

SQL = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, x -> CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), z -> z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op11_periodic_runs": r"""
        WITH crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
                CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        hashed AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                       list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS h
            FROM documents, crc),
        placed AS (SELECT *, len(words) AS n, h // 10 AS g, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM hashed),
        turned AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
        read AS (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
                THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE words END AS words
            FROM turned),
        flat AS (SELECT doc_id, n, unnest(words) AS word, unnest(range(n)) AS i FROM read),
        equal AS (
            SELECT x.doc_id, y.i - x.i AS q, x.i FROM flat x JOIN flat y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
        stretches AS (
            SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
        runs AS (
            SELECT * FROM stretches r WHERE NOT EXISTS (
                SELECT 1 FROM stretches z WHERE z.doc_id = r.doc_id AND z.q < r.q AND z.s <= r.s AND z.s + z.len >= r.s + r.len)),
        dropped AS (SELECT DISTINCT r.doc_id, x.i FROM runs r, unnest(range(r.s + r.q, r.s + r.len)) AS x(i)),
        collapsed AS (
            SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.i) AS said FROM flat f ANTI JOIN dropped d ON f.doc_id = d.doc_id AND f.i = d.i GROUP BY f.doc_id),
        best AS (
            SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (len * 1000000000000) // q DESC, s, q) = 1),
        listed AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(said, '')) AS collapsed_sha256
        FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id LEFT JOIN best b ON d.doc_id = b.doc_id LEFT JOIN collapsed c ON d.doc_id = c.doc_id""",
    "op12_collocations": r"""
        WITH split AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
        totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
        one AS (SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(w) AS g FROM pieces) GROUP BY ALL),
        two AS (SELECT lang, g[1] AS x, g[2] AS y, count(*) AS f FROM (
            SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS g FROM pieces) GROUP BY ALL HAVING count(*) >= 10),
        three AS (SELECT lang, g[1] AS x, g[2] AS y, g[3] AS z, count(*) AS f FROM (
            SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS g FROM pieces) GROUP BY ALL HAVING count(*) >= 10),
        over AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
        cuts AS (
            SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r
            FROM two t JOIN one p ON p.lang = t.lang AND p.g = t.x JOIN one q ON q.lang = t.lang AND q.g = t.y
            LEFT JOIN over o ON o.lang = t.lang AND o.x = t.x AND o.y = t.y WHERE o.f IS NULL OR 100 * o.f < 50 * t.f
            UNION ALL
            SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, p.f, q.f
            FROM three t JOIN one p ON p.lang = t.lang AND p.g = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
            UNION ALL
            SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, p.f, q.f
            FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.g = t.z),
        scored AS (SELECT *, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_repeated_bytes": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        windows AS (
            SELECT row, i, md5_number(substring(h, CAST(2 * i + 1 AS BIGINT), 400)) AS w
            FROM (SELECT row, h, unnest(range(CAST(length(h) // 2 - 199 AS BIGINT))) AS i FROM d WHERE length(h) >= 400)),
        twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
        begins AS (SELECT row, i, i + 200 AS e FROM windows SEMI JOIN twice USING (w)),
        marked AS (SELECT *, CASE WHEN i <= lag(e) OVER (PARTITION BY row ORDER BY i) THEN 0 ELSE 1 END AS new FROM begins),
        numbered AS (SELECT *, sum(new) OVER (PARTITION BY row ORDER BY i) AS span FROM marked),
        spans AS (SELECT row, span, min(i) AS s, max(e) AS e FROM numbered GROUP BY row, span),
        edges AS (SELECT row, e AS s, lead(s) OVER (PARTITION BY row ORDER BY s) AS e FROM (SELECT row, s, e FROM spans UNION ALL SELECT row, -1, 0 FROM d)),
        kept AS (SELECT row, string_agg(substring(h, CAST(2 * s + 1 AS BIGINT), CAST(coalesce(2 * (e - s), length(h)) AS BIGINT)), '' ORDER BY s) AS k
                 FROM edges JOIN d USING (row) GROUP BY row),
        counted AS (SELECT row, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY row)
        SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
        FROM d LEFT JOIN counted USING (row) LEFT JOIN kept USING (row)""",
}
