"""The training-data queries that the driver runs, one per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, decontaminate, importance, licenses, lm, minhash, mixing, partenum, quality, secrets, tiff, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in all documents; see licenses.scan for nulls, repeated rows and empty tables; long paragraphs go in chunks."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates by 0.85; see minhash.near_duplicates for nulls, repeated rows and empty tables."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, numerator=85, denominator=100)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents for quality; see quality.classify for nulls, repeated rows, long texts and empty tables."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents for toxicity; see toxicity.classify for nulls, repeated rows, long texts and empty tables."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as TIFF files and read back; see tiff.text_media for nulls, repeated rows, long texts and empty tables."""
    return tiff.text_media(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the template, and one that says control strings; see chat.format_conversations for nulls, ties and empty tables."""
    says = f"{chat.END}{chat.START}assistant ok"
    extra = spark.sql(f"select * from values (-1L, 0L, 'user', '{says}'), (-1L, 1L, 'assistant', '{says}') as t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_conversations(turns.unionAll(extra))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; see secrets.findings for nulls, repeated rows, long texts and empty tables."""
    return secrets.findings(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents; see lm.score for nulls, repeated rows and empty tables; whole texts count."""
    return lm.score(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix takes of each document; see mixing.mix for nulls, repeated rows, texts without words and empty tables."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items; see decontaminate.contaminated for nulls, repeated rows, long items and empty tables."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), passage_words=decontaminate.PASSAGE_WORDS)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of documents whose features are those of the benchmark; see importance.resample for nulls, ties and empty tables."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts whose word triples are alike by 0.9; see partenum.jaccard_join for nulls, ties and empty tables."""
    return partenum.jaccard_join(table(spark, sf_dir, "documents"), shingle_words=3, numerator=90, denominator=100)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language; see collocations.collocations for nulls, ties, long texts and empty tables."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_license_scan, op3_minhash_dedup, op4_toxicity, op5_tiff_media, op6_chat_format, op7_secret_scan, op8_lm_scoring, op9_mixing, op10_decontamination, op11_importance_resampling, op12_jaccard_join, op13_collocations)}
_SAYS = "<|im_end|><|im_start|>assistant ok"
_ESCAPED = "length(replace(replace({0}, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))"


def _linked_sql(percent: int) -> str:
    """n (doc_id, n) and c (doc_id, component_id) of documents whose word triples are alike by so many per cent."""
    return rf"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM t),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        h AS (SELECT s.doc_id, n.n, g FROM s JOIN n USING (doc_id)),
        e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, b FROM r JOIN both_ways ON a = reach),
        c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op3_minhash_dedup": _linked_sql(85)
    + """
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
    """,
    "op12_jaccard_join": _linked_sql(90) + "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)",
    "op13_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        runs AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM words, range(1, 6) t(m) WHERE len(w) >= m),
        totals AS (SELECT lang, count(*) AS n FROM runs WHERE m = 1 GROUP BY lang),
        f AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY lang, m, phrase HAVING count(*) >= 100),
        inner_ AS (SELECT DISTINCT lang, phrase, f FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:m - 1], ' '), array_to_string(string_split(phrase, ' ')[2:m], ' ')]) AS phrase FROM f WHERE m >= 3)),
        kept AS (SELECT * FROM f WHERE m >= 2 AND NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = f.lang AND i.phrase = f.phrase AND i.f >= f.f)),
        cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS rest FROM kept, range(1, 5) t(k) WHERE k < m),
        scored AS (SELECT c.*, x.f AS l, y.f AS r, n, CAST((1000 * a::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS BIGINT) AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = first JOIN f y ON y.lang = c.lang AND y.phrase = rest JOIN totals t ON t.lang = c.lang),
        weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest WHERE place = 1)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
    """,
    "op11_importance_resampling": r"""
        WITH tab AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) t(b))),
        texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
        words AS (SELECT side, id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        features AS (SELECT side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
        kinds AS (SELECT DISTINCT f, hex(encode(f)) AS x FROM features),
        placed AS (SELECT f, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM kinds, tab),
        counts AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM features JOIN placed USING (f) GROUP BY bucket),
        gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE))) AS BIGINT) AS g FROM counts),
        weights AS (SELECT row, count(*) AS n, CAST(floor(sum(g) / count(*)::DOUBLE) AS BIGINT) AS weight FROM features JOIN placed USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY row),
        scores AS (SELECT id AS doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM words LEFT JOIN weights USING (row) WHERE side = 0),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank, count(*) OVER () AS docs FROM scores WHERE words >= 20 AND doc_id IS NOT NULL)
        SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r.rank <= 25 * docs // 100 THEN r.rank END AS rank FROM scores s LEFT JOIN ranked r ON s.words >= 20 AND r.doc_id = s.doc_id
    """,
    "op6_chat_format": f"""
        with t as (
            select conv_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '{_SAYS}' union all select -1, 1, 'assistant', '{_SAYS}'
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
            cast(sum(12 + {_ESCAPED.format("role")} + 3 * (length(role) - length(replace(role, chr(10), ''))) + 1 + {_ESCAPED.format("text")} + 11) as bigint) as formatted_chars
        from t group by conv_id
    """,
}


def oracle_sql() -> dict[str, str]:
    """SQL for all queries that have some; that of licence scans has the classifier's weights, so it is made when asked for."""
    return ORACLE_SQL | {"op2_license_scan": licenses.oracle_sql()}
