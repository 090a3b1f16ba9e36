"""Query keys of the operators, one each over its whole table, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import (decontaminate, exact, jaccard, language, licenses, lines, mixing, pii, search, secrets, spelling,
                          substrings, toxicity as tox)
from riskflow.llm.store import fold, read_docs


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read_docs(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(read_docs(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_runs", "n_removed_lines", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_docs(spark, sf_dir)
    held = fold(F.col("doc_id"), 5) == 0
    model = tox.fit(docs, read_docs(spark, sf_dir, "labels"), ~held)
    return tox.toxicity(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "mean_difference")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(read_docs(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_scan(read_docs(spark, sf_dir)))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(read_docs(spark, sf_dir), read_docs(spark, sf_dir, "benchmark")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_docs(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_docs(spark, sf_dir)
    held = fold(F.col("doc_id"), 4) == 2
    model = language.fit(docs, ~held)
    return language.identify(docs, model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.license_scan(read_docs(spark, sf_dir)))


#: Token weights of the domains of ``labels``: quality (q) and toxic (t), 0 or 1.
TARGETS = {"q1t0": 0.93, "q0t0": 0.05, "q1t1": 0.015, "q0t1": 0.005}


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled rows; null where a label is."""
    return labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"),
                                            F.lit("t"), F.col("toxic").cast("string")).alias("domain"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_docs(spark, sf_dir)
    model = mixing.fit(docs, domains(read_docs(spark, sf_dir, "labels")), TARGETS)
    return mixing.apply(docs, model).select(
        "doc_id", "mix_domain", "mix_tokens", "mix_rate", "mix_copies",
        *[F.get("mix_posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(model.domains)])


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_docs(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(read_docs(spark, sf_dir), read_docs(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(read_docs(spark, sf_dir)))


QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op2_line_dedup": op2_line_dedup, "op3_toxicity": op3_toxicity,
           "op4_substring_dedup": op4_substring_dedup, "op5_secret_scan": op5_secret_scan,
           "op6_decontaminate": op6_decontaminate,
           "op7_jaccard_join": op7_jaccard_join, "op8_language": op8_language, "op9_license_scan": op9_license_scan,
           "op10_mixture": op10_mixture, "op11_spelling_variants": op11_spelling_variants,
           "op12_lexical_search": op12_lexical_search, "op13_personal_data": op13_personal_data}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
             g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
        FROM t JOIN g USING (x)""",
    # Every two adjacent lines but blank ones are a chunk; a line goes with any chunk that is not the first of its text.
    "op2_line_dedup": r"""
        WITH l AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS follow
                   FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) AS s),
             c AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, follow ORDER BY doc_id, i) > 1 AS again
                   FROM l WHERE follow IS NOT NULL AND regexp_matches(line || follow, '[^\x09-\x0D\x20]')),
             g AS (SELECT doc_id, i FROM c WHERE again UNION SELECT doc_id, i + 1 FROM c WHERE again),
             f AS (SELECT l.*, g.i IS NOT NULL AS gone, coalesce(lag(g.i) OVER (PARTITION BY l.doc_id ORDER BY l.i), -1) AS before
                   FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone AND before <> i - 1) AS n_runs, count(*) FILTER (gone) AS n_removed_lines,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM f GROUP BY doc_id""",
    "op12_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
             s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
             q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
             p AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf
                   FROM (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d) AS u
                   WHERE t IN (SELECT t FROM q) GROUP BY ALL),
             w AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * (SELECT n_docs FROM s) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
                   FROM p GROUP BY t),
             g AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS gain
                   FROM p JOIN w USING (t) CROSS JOIN s),
             f AS (SELECT item_id, r, doc_id, sum(gain)::BIGINT AS score FROM q JOIN g USING (t) GROUP BY ALL HAVING sum(gain) > 0),
             o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM f)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 10""",
    # crc32 byte by byte from its table; near words meet by a deletion, or by one place left open.
    "op11_spelling_variants": r"""
        WITH RECURSIVE
             tab AS (SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8],
                            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
                     FROM (SELECT unnest(range(256))::BIGINT AS i) AS b),
             run AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w
                     FROM documents),
             low AS (SELECT id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
                     FROM run WHERE length(w) >= 7 GROUP BY ALL),
             crc AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || w, ''),
                            lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
                            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM low, tab),
             cut AS (SELECT c, CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM crc),
             voc AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
             pos AS MATERIALIZED (SELECT word, n, unnest(range(length(word))) AS i FROM voc),
             open AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM pos),
             pair AS MATERIALIZED (SELECT DISTINCT a.word AS a, a.n AS na, b.word AS b, b.n AS nb FROM open AS a JOIN voc AS b ON a.rest = b.word
                      UNION SELECT a.word, a.n, b.word, b.n FROM open AS a JOIN open AS b ON a.rest = b.rest AND a.i = b.i AND a.word < b.word),
             side AS (SELECT a AS word, b AS o, nb AS m FROM pair UNION ALL SELECT b, a, na FROM pair),
             best AS (SELECT word, count(*) AS n_near, min({'m': -m, 'o': o}) AS x FROM side GROUP BY word),
             form AS MATERIALIZED (SELECT voc.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -x.m >= 10 * n THEN x.o END AS form,
                      CASE WHEN -x.m >= 10 * n THEN -x.m END AS form_n FROM voc LEFT JOIN best USING (word)),
             chain AS (SELECT word, word AS at FROM form UNION ALL
                       SELECT chain.word, form.form FROM chain JOIN form ON chain.at = form.word WHERE form.form IS NOT NULL)
        SELECT form.word, form.form, chain.at AS root, form.n, form.n_near, form.form_n
        FROM form JOIN chain ON form.word = chain.word JOIN form AS top ON chain.at = top.word AND top.form IS NULL""",
}
