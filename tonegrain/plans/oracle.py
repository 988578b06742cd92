"""SQL counterparts of the catalogue, for DuckDB over the same Parquet tables.

Written from the definitions, in plain SQL, without a look at how Spark does it.
"""

from __future__ import annotations

from tonegrain.operators.classifier import FOLDS, candidates
from tonegrain.operators.requests import NO_TEXT_DETAIL
from tonegrain.plans.catalog import INTERCEPTS, LEXICON, MODEL_URI, SEED
from tonegrain.schema import CLASSES, NA_TOKENS
from tonegrain.sources.requests import TEXT_TYPE, TEXTS_TYPE

# --- shared relations ------------------------------------------------------

_NEWS_RAW = """
news_raw AS (
  SELECT
    d.doc_id AS row_id,
    CASE WHEN d.doc_id % 97 = 5 THEN 'not a date'
         WHEN d.doc_id % 89 = 5 THEN '2024-03-01'
         ELSE printf('2024-%02d-%02d %02d:%02d:00', 1 + (d.doc_id * 7) % 12,
                     1 + (d.doc_id * 5) % 28, d.doc_id % 24, d.doc_id % 60) END AS date,
    CASE WHEN l.doc_id IS NULL AND d.doc_id % 2 = 0 THEN NULL
         ELSE concat('{''class'': ''',
                CASE WHEN l.doc_id IS NULL THEN 'mixed'
                     WHEN l.toxic = 1 THEN 'negative'
                     WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END,
                ''', ''polarity'': ',
                CASE WHEN d.doc_id % 23 = 0 THEN 'None'
                     WHEN l.toxic = 1 THEN printf('-0.%02d', 1 + d.doc_id % 99)
                     ELSE printf('0.%02d', d.doc_id % 100) END,
                ', ''subjectivity'': ', printf('0.%02d', (d.doc_id * 3) % 100), '}')
         END AS sentiment,
    CASE WHEN d.doc_id % 101 = 3 THEN NULL ELSE d.source END AS source,
    d.lang AS subject,
    CASE WHEN d.doc_id % 17 = 0 THEN NULL
         WHEN d.doc_id % 19 = 0 THEN concat('. ..', split_part(d.text, chr(10), 1))
         ELSE split_part(d.text, chr(10), 1) END AS title,
    CASE WHEN d.doc_id % 13 = 0 OR instr(d.text, chr(10)) = 0 THEN NULL
         ELSE substr(d.text, instr(d.text, chr(10)) + 1) END AS text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

_NEWS_PARSED = r"""
news_parsed AS (
  SELECT row_id, try_strptime(date, '%Y-%m-%d %H:%M:%S') AS date, sentiment, source, subject,
    title, text,
    CASE WHEN sentiment IS NOT NULL THEN regexp_extract(sentiment, '''class'': ''([^'']*)''', 1) END AS class,
    try_cast(regexp_extract(sentiment, '''polarity'': ([^,}]*)', 1) AS DOUBLE) AS polarity,
    try_cast(regexp_extract(sentiment, '''subjectivity'': ([^,}]*)', 1) AS DOUBLE) AS subjectivity
  FROM news_raw
)"""

_CLEAN = """
passing AS (
  SELECT *, ltrim(concat(coalesce(title, ''), '. ', coalesce(text, '')), '. ') AS input_text
  FROM news_parsed
  WHERE date IS NOT NULL AND sentiment IS NOT NULL AND source IS NOT NULL
    AND subject IS NOT NULL AND (text IS NOT NULL OR title IS NOT NULL)
    AND class IN ('negative', 'neutral', 'positive')
),
news_clean AS (
  SELECT row_id, date, source, subject, title, text, class, polarity, subjectivity, input_text
  FROM passing
  QUALIFY row_number() OVER (PARTITION BY text, title, class ORDER BY date, row_id) = 1
)"""

_PREDICTIONS = """
predictions AS (
  SELECT row_id, class,
    CASE WHEN row_id % 5 = 0 THEN CASE class WHEN 'positive' THEN 'neutral'
         WHEN 'neutral' THEN 'negative' ELSE 'positive' END ELSE class END AS pred_linear,
    CASE WHEN row_id % 7 = 0 THEN CASE class WHEN 'positive' THEN 'negative'
         WHEN 'neutral' THEN 'positive' ELSE 'neutral' END ELSE class END AS pred_encoder,
    CAST(5 + row_id % 11 AS INT) AS latency_linear_ms,
    CAST(40 + row_id % 37 AS INT) AS latency_encoder_ms
  FROM news_clean
)"""

_TOKENS = r"regexp_extract_all(lower(input_text), '[\p{L}\p{N}_]{2,}')"
_BIGRAMS = (
    "list_concat(tok, list_transform(range(1, len(tok)), "
    "lambda i: tok[i] || ' ' || tok[i + 1]))"
)

_TERMS = f"""
tokens AS (SELECT row_id, input_text, class, {_TOKENS} AS tok FROM news_clean),
term_counts AS (
  SELECT row_id, term, count(*) AS tf
  FROM (SELECT row_id, unnest(tok) AS term FROM tokens) GROUP BY row_id, term
),
doc_freqs AS (SELECT term, count(*) AS df FROM term_counts GROUP BY term),
vocab AS (
  SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM doc_freqs, (SELECT count(*) AS n FROM news_clean)
  WHERE df >= 5 AND df <= 0.8 * n
),
coefficients AS (
  SELECT term, class,
    CAST(((length(term) * 7 + ascii(term) * k) % 11 - 5) / 10.0 AS DOUBLE) AS weight
  FROM vocab CROSS JOIN (VALUES ('negative', 1), ('neutral', 2), ('positive', 3)) c(class, k)
)"""

_RUNS = """
runs AS (
  SELECT event_type AS name, event_id AS run_id, ts AS logged_at, value / 100.0 AS test_f1_score
  FROM events
),
history AS (
  SELECT *, row_number() OVER w AS version,
    max(test_f1_score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
  FROM runs WINDOW w AS (PARTITION BY name ORDER BY logged_at, run_id)
),
decided AS (
  SELECT *, best_before IS NULL OR test_f1_score > best_before AS promoted FROM history
)"""

_REQUESTS = """
requests AS (
  SELECT concat(conv_id, '-', turn) AS request_id,
    CASE WHEN role = 'user' THEN body END AS input_text,
    CASE WHEN role <> 'user' THEN string_split(body, chr(10)) END AS input_texts
  FROM (
    SELECT conv_id, turn, role,
      CASE WHEN conv_id % 5 = 0 THEN '   ' WHEN conv_id % 7 = 3 THEN ''
           WHEN conv_id % 3 = 0 THEN concat('  ', text, ' ') ELSE text END AS body
    FROM conversations
  )
),
request_texts AS (
  SELECT request_id, input_text,
    list_filter(
      list_transform(CASE WHEN input_text IS NOT NULL THEN [input_text] ELSE input_texts END,
        lambda t: regexp_replace(t, '^[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+|[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+$', '', 'g')),
      lambda t: length(t) > 0) AS texts
  FROM requests
),
items AS (
  SELECT request_id, CAST(unnest(range(len(texts))) AS INT) AS pos, unnest(texts) AS text
  FROM request_texts WHERE input_text IS NULL OR length(input_text) > 0
)""".replace("\\\\", "\\")


def _with(select: str, *relations: str) -> str:
    return f"WITH {','.join(relations)}\n{select.strip()}"


def _raw(select: str) -> str:
    return _with(select, _NEWS_RAW)


def _parsed(select: str) -> str:
    return _with(select, _NEWS_RAW, _NEWS_PARSED)


def _clean(select: str, *more: str) -> str:
    return _with(select, _NEWS_RAW, _NEWS_PARSED, _CLEAN, *more)


def _predicted(select: str, *more: str) -> str:
    return _clean(select, _PREDICTIONS, *more)


def _terms(select: str, *more: str) -> str:
    return _clean(select, _TERMS, *more)


def _runs(select: str) -> str:
    return _with(select, _RUNS)


def _requests(select: str) -> str:
    return _with(select, _REQUESTS)


def _na(column: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in NA_TOKENS)
    return f"CASE WHEN {column} NOT IN ({tokens}) THEN {column} END AS {column}"


_RAW_STRINGS = ("date", "sentiment", "source", "subject", "title", "text")
_NA_NORMALISED = _raw(
    f"SELECT row_id, {', '.join(_na(c) for c in _RAW_STRINGS)} FROM news_raw"
)
_CSV_SCAN = _raw(f"SELECT {', '.join(_na(c) for c in _RAW_STRINGS)} FROM news_raw")


def _dup_rows(*keys: str) -> str:
    columns = ", ".join(keys)
    return _raw(
        f"""SELECT row_id, {columns} FROM news_raw
        QUALIFY count(*) OVER (PARTITION BY {columns}) > 1"""
    )


def _distinct(column: str) -> str:
    return _parsed(f"SELECT DISTINCT {column} FROM news_parsed")


def _trend(grain: str) -> str:
    return _clean(
        f"""SELECT CAST(date_trunc('{grain}', date) AS DATE) AS bucket, class, count(*) AS n_rows
        FROM news_clean GROUP BY 1, 2"""
    )


def _trend_mean(measure: str) -> str:
    return _clean(
        f"""SELECT CAST(date_trunc('day', date) AS DATE) AS bucket,
          round(avg({measure}), 6) AS mean_{measure}
        FROM news_clean GROUP BY 1"""
    )


def _by(column: str) -> str:
    return _clean(
        f"""SELECT {column}, class, count(*) AS n_rows,
          round(count(*) / sum(count(*)) OVER (PARTITION BY {column}), 6) AS share
        FROM news_clean GROUP BY {column}, class"""
    )


def _per_class(by: str, predictions: str) -> str:
    """Relation ``per_class``: tp, support and predicted rows per label."""
    return f"""
labelled AS ({predictions}),
per_class AS (
  SELECT {by} label,
    sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted,
    CASE WHEN sum(predicted) > 0 THEN sum(tp) / sum(predicted) ELSE 0 END AS p,
    CASE WHEN sum(support) > 0 THEN sum(tp) / sum(support) ELSE 0 END AS r,
    2 * sum(tp) / (sum(support) + sum(predicted)) AS f
  FROM (
    SELECT {by} class AS label, CAST(class = prediction AS INT) AS tp, 1 AS support, 0 AS predicted
    FROM labelled
    UNION ALL
    SELECT {by} prediction, 0, 0, 1 FROM labelled
  ) GROUP BY {by} label
)"""


_LINEAR = _per_class("", "SELECT class, pred_linear AS prediction FROM predictions")

_DESCRIBE = """
    count(*) AS n_rows, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std,
    min({v})::BIGINT AS min, round(quantile_cont({v}, 0.25), 6) AS p25,
    round(quantile_cont({v}, 0.5), 6) AS p50, round(quantile_cont({v}, 0.75), 6) AS p75,
    max({v})::BIGINT AS max"""

# Fold f of a class takes the places of the row of all classes that leave f, as one stretch in hash order.
_FOLDS = f"""
folds AS (
  SELECT row_id, class, CAST(count(f) AS INT) AS fold FROM (
    SELECT row_id, class,
      row_number() OVER (PARTITION BY class ORDER BY md5(concat('{SEED}:', row_id)), row_id) AS rank
    FROM news_clean
  ) JOIN (
    SELECT class, list(behind ORDER BY f) AS cuts FROM (
      SELECT class, f, sum(count(*) FILTER (WHERE place % 5 = f)) OVER (PARTITION BY class ORDER BY f) AS behind
      FROM (SELECT class, row_number() OVER (ORDER BY class) - 1 AS place FROM news_clean), range(4) t(f)
      GROUP BY class, f
    ) GROUP BY class
  ) USING (class) LEFT JOIN range(1, 5) t(f) ON rank > cuts[f]
  GROUP BY row_id, class
)"""

_SPLIT = f"""
split_rows AS (
  SELECT row_id, class, CASE WHEN rank <= n_test THEN 'test' ELSE 'train' END AS split
  FROM (
    SELECT row_id, class, row_number() OVER (
      PARTITION BY class ORDER BY md5(concat('{SEED}:', row_id)), row_id) AS rank
    FROM news_clean
  ) JOIN (
    SELECT class, share + CAST(row_number() OVER (ORDER BY rest DESC, class)
      <= all_test - sum(share) OVER () AS INT) AS n_test
    FROM (
      SELECT class, all_test, n * all_test // total AS share, n * all_test % total AS rest
      FROM (
        SELECT class, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total,
          ceil(0.25 * sum(count(*)) OVER ())::BIGINT AS all_test
        FROM news_clean GROUP BY class
      )
    )
  ) USING (class)
)"""


def _split(select: str) -> str:
    return _clean(select, _SPLIT)


# Documents to score come as ``docs(row_id, input_text)``.
_SCORES = f"""
doc_terms AS (
  SELECT row_id, term, count(*) AS tf
  FROM (SELECT row_id, unnest({_TOKENS}) AS term FROM docs) GROUP BY row_id, term
),
doc_weights AS (
  SELECT row_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY row_id)) AS weight
  FROM doc_terms JOIN vocab USING (term)
),
sums AS (
  SELECT row_id, class, sum(w.weight * c.weight) AS s
  FROM doc_weights w JOIN coefficients c USING (term) GROUP BY row_id, class
),
logits AS (
  SELECT d.row_id, i.class, coalesce(s, 0) + i.b AS z
  FROM docs d CROSS JOIN (VALUES {', '.join(f"('{c}', {b})" for c, b in INTERCEPTS.items())}) i(class, b)
  LEFT JOIN sums USING (row_id, class)
),
scores AS (
  SELECT row_id, arg_max(class, z) AS sentiment,
    {', '.join(f"sum(exp(z)) FILTER (class = '{c}') / sum(exp(z)) AS p_{c}" for c in CLASSES)}
  FROM logits GROUP BY row_id
)"""

_PROBABILITIES = ", ".join(f"round(p_{c}, 6) AS p_{c}" for c in CLASSES)

_SCORED_TEXTS = _terms(
    f"SELECT row_id, sentiment, {_PROBABILITIES} FROM scores",
    "docs AS (SELECT row_id, input_text FROM news_clean)",
    _SCORES,
)

_ITEM_DOCS = "docs AS (SELECT concat(pos, '#', request_id) AS row_id, text AS input_text FROM items)"

_SCORED_REQUESTS = _terms(
    f"""SELECT request_id, pos, sentiment, {_PROBABILITIES}
    FROM items JOIN scores ON row_id = concat(pos, '#', request_id)""",
    _REQUESTS,
    _ITEM_DOCS,
    _SCORES,
)


def _served(version: str) -> str:
    return _requests(
        f"""SELECT request_id, pos, 'models:/linear@production' AS model_uri, 'linear' AS name, 'production' AS alias,
          CAST(version AS BIGINT) AS version, concat('run-0.', 4 + version) AS run_id,
          CAST(1.0 AS DOUBLE) AS probability_sum, true AS known, true AS timed
        FROM (SELECT request_id, pos, {version} AS version FROM items)"""
    )


def _word_count(kind: str, tokens: str) -> str:
    words = ", ".join(f"'{w}'" for w in LEXICON[kind])
    return f"len(list_filter({tokens}, lambda w: w IN ({words})))"


_REQUEST_INVALID = """SELECT request_id, 'request_failed' AS error,
  'input_text must have at least 1 character' AS detail, 422 AS status
FROM requests WHERE length(input_text) = 0"""


def _request_no_text(valid_only: bool) -> str:
    valid = "AND (input_text IS NULL OR length(input_text) > 0)" if valid_only else ""
    detail = NO_TEXT_DETAIL.replace("'", "''")
    return f"""SELECT request_id, 'request_failed' AS error, '{detail}' AS detail, 400 AS status
    FROM request_texts WHERE len(texts) = 0 {valid}"""


def _grid() -> str:
    lines = " UNION ALL ".join(
        f"""SELECT {i}::BIGINT AS candidate_id, {c['max_iter']}::BIGINT AS max_iter,
          CAST({c['max_df']} AS DOUBLE) AS max_df, {c['min_df']}::BIGINT AS min_df,
          {c['ngram_max']}::BIGINT AS ngram_max"""
        for i, c in enumerate(candidates())
    )
    return _clean(
        f"""SELECT candidate_id, max_iter, max_df, min_df, ngram_max, count(*) AS n_terms
        FROM ({lines}) g, gram_df, (SELECT count(*) AS n FROM news_clean)
        WHERE words <= ngram_max AND df >= min_df AND df <= max_df * n
        GROUP BY ALL""",
        f"""
tokens AS (SELECT row_id, {_TOKENS} AS tok FROM news_clean),
gram_df AS (
  SELECT term, 1 + len(term) - len(replace(term, ' ', '')) AS words, count(*) AS df
  FROM (SELECT unnest(list_distinct({_BIGRAMS})) AS term FROM tokens) GROUP BY term
)""",
    )


_PROFILE_COLUMNS = (
    ("row_id", "bigint"),
    ("date", "timestamp"),
    ("sentiment", "string"),
    ("source", "string"),
    ("subject", "string"),
    ("title", "string"),
    ("text", "string"),
    ("class", "string"),
    ("polarity", "double"),
    ("subjectivity", "double"),
)

_STREAM_CLEAN = _clean(
    """SELECT row_id, date, source, subject, title, text, class, polarity, subjectivity, input_text
    FROM passing"""
)

# --- queries ---------------------------------------------------------------

ORACLE: dict[str, str] = {
    "csv_scan": _CSV_SCAN,
    "na_normalise": _NA_NORMALISED,
    "load_stats": _raw("SELECT count(*) AS n_rows, 7::BIGINT AS n_columns FROM news_raw"),
    "run_log": _predicted(
        """SELECT concat('run-', model) AS run_id, concat('pred_', model) AS prediction_column,
          'test_f1_score' AS metric, round(avg(f), 6) AS value
        FROM per_class GROUP BY model""",
        _per_class(
            "model,",
            """SELECT 'linear' AS model, class, pred_linear AS prediction FROM predictions
            UNION ALL SELECT 'encoder', class, pred_encoder FROM predictions""",
        ),
    ),
    "request_scan": _requests(
        """SELECT request_id, input_text, array_to_string(input_texts, chr(10)) AS input_texts
        FROM requests"""
    ),
    "response_sink": _terms(
        f"""SELECT request_id, '{MODEL_URI}' AS model_uri, count(*) AS n_predictions,
          string_agg(sentiment, ',' ORDER BY pos) AS sentiments,
          round(count(*)::DOUBLE, 6) AS probability_sum, 8::BIGINT AS latency_ms
        FROM items JOIN scores ON row_id = concat(pos, '#', request_id) GROUP BY request_id""",
        _REQUESTS,
        _ITEM_DOCS,
        _SCORES,
    ),
    "coerce_date": _parsed("SELECT row_id, date FROM news_parsed"),
    "drop_missing_mandatory": _raw(
        """SELECT row_id, try_strptime(date, '%Y-%m-%d %H:%M:%S') AS date, sentiment, source,
          subject, title, text
        FROM news_raw
        WHERE try_strptime(date, '%Y-%m-%d %H:%M:%S') IS NOT NULL AND sentiment IS NOT NULL
          AND source IS NOT NULL AND subject IS NOT NULL"""
    ),
    "drop_missing_body": _raw(
        "SELECT * FROM news_raw WHERE NOT (text IS NULL AND title IS NULL)"
    ),
    "reject_report": _clean(
        """SELECT reject_reason, n_rows FROM (
          SELECT 'missing' AS reject_reason, count(*) AS n_rows FROM news_parsed
          WHERE date IS NULL OR sentiment IS NULL OR source IS NULL OR subject IS NULL
            OR (text IS NULL AND title IS NULL)
          UNION ALL
          SELECT 'invalid_class', count(*) FROM news_parsed
          WHERE NOT (date IS NULL OR sentiment IS NULL OR source IS NULL OR subject IS NULL
            OR (text IS NULL AND title IS NULL))
            AND (class IS NULL OR class NOT IN ('negative', 'neutral', 'positive'))
          UNION ALL
          SELECT 'duplicate', (SELECT count(*) FROM passing) - (SELECT count(*) FROM news_clean)
        ) WHERE n_rows > 0"""
    ),
    "reject_rows": _clean(
        """SELECT row_id, CASE
            WHEN date IS NULL OR sentiment IS NULL OR source IS NULL OR subject IS NULL
              OR (text IS NULL AND title IS NULL) THEN 'missing'
            WHEN class IS NULL OR class NOT IN ('negative', 'neutral', 'positive')
              THEN 'invalid_class'
            ELSE 'duplicate' END AS reject_reason
        FROM news_parsed WHERE row_id NOT IN (SELECT row_id FROM news_clean)"""
    ),
    "parse_sentiment": _raw(
        r"""SELECT row_id,
          CASE WHEN sentiment IS NOT NULL THEN regexp_extract(sentiment, '''class'': ''([^'']*)''', 1) END AS class,
          nullif(regexp_extract(sentiment, '''polarity'': ([^,}]*)', 1), 'None') AS polarity,
          nullif(regexp_extract(sentiment, '''subjectivity'': ([^,}]*)', 1), 'None') AS subjectivity
        FROM news_raw"""
    ),
    "coerce_scores": _parsed("SELECT row_id, polarity, subjectivity FROM news_parsed"),
    "valid_class": _parsed(
        """SELECT row_id, class FROM news_parsed
        WHERE class IN ('negative', 'neutral', 'positive')"""
    ),
    "build_input_text": _raw(
        """SELECT row_id,
          ltrim(concat(coalesce(title, ''), '. ', coalesce(text, '')), '. ') AS input_text
        FROM news_raw"""
    ),
    "feature_projection": _clean("SELECT row_id, input_text, class FROM news_clean"),
    "clean_news": _clean("SELECT * FROM news_clean"),
    "dashboard_filter": _clean(
        f"""SELECT * FROM news_clean
        WHERE CAST(date AS DATE) BETWEEN DATE '2024-02-01' AND DATE '2024-09-30'
          AND source IN ({', '.join(f"'src{i}'" for i in range(15))})
          AND subject IN ('en', 'fr', 'de')"""
    ),
    "request_clean": _requests("SELECT request_id, pos, text FROM items"),
    "request_reject": _requests(_request_no_text(valid_only=False)),
    "request_validate": _requests(_REQUEST_INVALID),
    "invalid_dates": _raw(
        """SELECT row_id, date AS date_raw FROM news_raw
        WHERE try_strptime(date, '%Y-%m-%d %H:%M:%S') IS NULL"""
    ),
    "dedup_keep_first": _parsed(
        """SELECT row_id, date, class FROM news_parsed
        QUALIFY row_number() OVER (
          PARTITION BY text, title, class ORDER BY date NULLS LAST, row_id) = 1"""
    ),
    "dup_ratio": _raw(
        """SELECT count(*) AS n_rows, (count(*) - count(DISTINCT row(text)))::BIGINT AS n_repeats,
          round((count(*) - count(DISTINCT row(text))) / count(*), 6) AS dup_ratio
        FROM news_raw"""
    ),
    "dup_text_rows": _dup_rows("text"),
    "dup_title_rows": _dup_rows("title"),
    "dup_text_title_rows": _dup_rows("title", "text"),
    "removed_rows": _parsed(
        """SELECT row_id, date, title, text, class FROM news_parsed
        QUALIFY row_number() OVER (
          PARTITION BY text, title, class ORDER BY date NULLS LAST, row_id) > 1"""
    ),
    "class_count": _clean("SELECT class, count(*) AS n_rows FROM news_clean GROUP BY class"),
    "class_ratio": _clean(
        """SELECT class, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 6) AS ratio
        FROM news_clean GROUP BY class"""
    ),
    "date_range": _parsed("SELECT min(date) AS min_date, max(date) AS max_date FROM news_parsed"),
    "null_flags": _parsed(
        "SELECT "
        + ", ".join(
            f"bool_or({c} IS NULL) AS {c}_has_null"
            for c in ("date", "sentiment", "source", "subject", "text", "title")
        )
        + " FROM news_parsed"
    ),
    "table_profile": _parsed(
        " UNION ALL ".join(
            f"""SELECT {i}::BIGINT AS position, '{name}' AS column_name, '{kind}' AS column_type,
              count({name}) AS non_null, count(*) AS n_rows FROM news_parsed"""
            for i, (name, kind) in enumerate(_PROFILE_COLUMNS)
        )
    ),
    "head_rows": _raw("SELECT * FROM news_raw ORDER BY row_id LIMIT 5"),
    **{
        f"distinct_{c}": _distinct(c)
        for c in ("source", "subject", "class", "polarity", "subjectivity")
    },
    "text_len_by_class": _parsed(
        f"""SELECT class, {_DESCRIBE.format(v='length(text)')}
        FROM news_parsed WHERE class IS NOT NULL AND text IS NOT NULL GROUP BY class"""
    ),
    "text_len_sketch": _parsed(
        """SELECT class, count(*) AS n_rows, true AS p25_holds, true AS p50_holds, true AS p75_holds
        FROM news_parsed WHERE class IS NOT NULL AND text IS NOT NULL GROUP BY class"""
    ),
    "latency_sketch": _predicted(
        """SELECT model, count(*) AS n_rows, true AS p25_holds, true AS p50_holds, true AS p75_holds
        FROM (SELECT 'linear' AS model, latency_linear_ms AS latency_ms FROM predictions
              UNION ALL SELECT 'encoder', latency_encoder_ms FROM predictions)
        WHERE latency_ms IS NOT NULL GROUP BY model"""
    ),
    "confusion": _predicted(
        """SELECT class, pred_linear AS prediction, count(*) AS n_rows
        FROM predictions GROUP BY 1, 2"""
    ),
    "macro_f1": _predicted("SELECT round(avg(f), 6) AS macro_f1 FROM per_class", _LINEAR),
    "classification_report": _predicted(
        """SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score,
          support::BIGINT AS support FROM per_class
        UNION ALL
        SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support)::BIGINT
        FROM per_class
        UNION ALL
        SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6),
          sum(support)::BIGINT FROM per_class
        UNION ALL
        SELECT 'weighted avg', round(sum(p * support) / sum(support), 6),
          round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6),
          sum(support)::BIGINT FROM per_class""",
        _LINEAR,
    ),
    "class_weight": _clean(
        """SELECT class, count(*) AS n_rows,
          round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
        FROM news_clean GROUP BY class"""
    ),
    "trend_count": _trend("day"),
    "trend_count_week": _trend("week"),
    "trend_count_month": _trend("month"),
    "trend_count_year": _trend("year"),
    "trend_count_filled": _clean(
        """SELECT bucket, class, coalesce(n_rows, 0) AS n_rows
        FROM (
          SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS bucket
          FROM (SELECT date_trunc('day', min(date)) AS lo, date_trunc('day', max(date)) AS hi
                FROM news_clean)
        ) CROSS JOIN (SELECT DISTINCT class FROM news_clean)
        LEFT JOIN (
          SELECT CAST(date_trunc('day', date) AS DATE) AS bucket, class, count(*) AS n_rows
          FROM news_clean GROUP BY 1, 2
        ) USING (bucket, class)"""
    ),
    "trend_share": _clean(
        """SELECT CAST(date_trunc('day', date) AS DATE) AS bucket, class, count(*) AS n_rows,
          round(count(*) / sum(count(*)) OVER (PARTITION BY CAST(date_trunc('day', date) AS DATE)), 6)
            AS share
        FROM news_clean GROUP BY 1, 2"""
    ),
    "trend_polarity": _trend_mean("polarity"),
    "trend_subjectivity": _trend_mean("subjectivity"),
    "by_source": _by("source"),
    "by_subject": _by("subject"),
    "breakdown_sets": _clean(
        """SELECT source, subject, class, grouping(source, subject, class)::BIGINT AS grouping_set,
          count(*) AS n_rows
        FROM news_clean GROUP BY GROUPING SETS ((source, class), (subject, class), (class))"""
    ),
    "cube_trends": _clean(
        """SELECT bucket, class, n_rows, round(n_rows / sum(n_rows) OVER w, 6) AS share,
          round(sum(p) OVER w / sum(np) OVER w, 6) AS mean_polarity,
          round(sum(s) OVER w / sum(ns) OVER w, 6) AS mean_subjectivity
        FROM (SELECT CAST(date_trunc('week', date) AS DATE) AS bucket, class, count(*) AS n_rows,
            sum(polarity) AS p, count(polarity) AS np, sum(subjectivity) AS s, count(subjectivity) AS ns
          FROM news_clean GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY bucket)"""
    ),
    "cube_breakdowns": _clean(
        """SELECT source, subject, class, grouping(source, subject, class)::BIGINT AS grouping_set,
          count(*) AS n_rows
        FROM news_clean WHERE date >= DATE '2024-02-10' AND date < DATE '2024-09-21'
        GROUP BY GROUPING SETS ((source, class), (subject, class), (class))"""
    ),
    "latest_samples": _clean(
        """SELECT * FROM news_clean WHERE subject = 'en' ORDER BY date DESC, row_id LIMIT 10"""
    ),
    "latest_per_group": _clean(
        """SELECT *, row_number() OVER (PARTITION BY source ORDER BY date DESC, row_id) AS rank
        FROM news_clean QUALIFY rank <= 10"""
    ),
    "model_compare": _predicted(
        """SELECT row_id, class, pred_linear AS prediction_a, pred_encoder AS prediction_b,
          pred_linear = pred_encoder AS is_match FROM predictions"""
    ),
    "match_rate": _predicted(
        """SELECT coalesce(class, 'all') AS class, count(*) AS n_rows,
          round(avg(CAST(pred_linear = pred_encoder AS INT)), 6) AS match_rate
        FROM predictions GROUP BY ROLLUP (class)"""
    ),
    "latency_summary": _predicted(
        f"""SELECT model, {_DESCRIBE.format(v='latency_ms')}
        FROM (SELECT 'linear' AS model, latency_linear_ms AS latency_ms FROM predictions
              UNION ALL SELECT 'encoder', latency_encoder_ms FROM predictions)
        GROUP BY model"""
    ),
    "stratified_split": _clean("SELECT row_id, class, split FROM split_rows", _SPLIT),
    "stratified_kfold": _clean("SELECT row_id, class, fold FROM folds", _FOLDS),
    "tokenize": _terms(
        """SELECT row_id, len(tok) AS n_tokens, array_to_string(tok, ' ') AS tokens FROM tokens"""
    ),
    "ngrams": _terms(
        f"""SELECT row_id, len(grams) AS n_terms, array_to_string(grams, '|') AS terms
        FROM (SELECT row_id, {_BIGRAMS} AS grams FROM tokens)"""
    ),
    "term_count": _terms("SELECT row_id, term, tf FROM term_counts"),
    "doc_freq": _terms("SELECT term, df FROM doc_freqs"),
    "vocab_prune": _terms("SELECT term, df FROM vocab"),
    "idf": _terms("SELECT term, round(idf, 6) AS idf FROM vocab"),
    "tfidf": _terms(
        """SELECT row_id, term,
          round(tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY row_id)), 6) AS weight
        FROM term_counts JOIN vocab USING (term)"""
    ),
    "grid": _grid(),
    "cv_results": _predicted(
        """SELECT candidate_id, round(avg(score), 6) AS mean_score,
          round(stddev_pop(score), 6) AS std_score, rank() OVER (ORDER BY avg(score) DESC) AS rank
        FROM (SELECT candidate_id, fold, avg(f) AS score FROM per_class GROUP BY ALL)
        GROUP BY candidate_id""",
        _FOLDS,
        _per_class(
            "candidate_id, fold,",
            """SELECT 0::BIGINT AS candidate_id, fold, p.class, pred_linear AS prediction
            FROM predictions p JOIN folds USING (row_id)
            UNION ALL
            SELECT 1, fold, p.class, pred_encoder FROM predictions p JOIN folds USING (row_id)""",
        ),
    ),
    "linear_score": _SCORED_TEXTS,
    "score_texts": _SCORED_TEXTS,
    "encoder_score": _terms(
        f"""SELECT row_id,
          CASE WHEN up > down THEN 'positive' WHEN down > up THEN 'negative' ELSE 'neutral' END
            AS sentiment,
          round(CASE WHEN up + down > 0 THEN greatest(up, down) / (up + down) ELSE 0 END, 6) AS score
        FROM (SELECT row_id, {_word_count('positive', 'tok')} AS up,
                {_word_count('negative', 'tok')} AS down FROM tokens)"""
    ),
    "score_requests": _SCORED_REQUESTS,
    "assign_version": _runs("SELECT name, run_id, version FROM history"),
    "promote": _runs(
        """SELECT name, run_id, version, round(test_f1_score, 6) AS test_f1_score,
          round(best_before, 6) AS best_before, promoted FROM decided"""
    ),
    "promote_candidate": _runs(
        """SELECT name, 'production' AS alias, max(version) FILTER (promoted) AS version
        FROM decided GROUP BY name"""
    ),
    "production_meta": _runs(
        """SELECT n.name, 'production' AS alias, v.version, v.run_id
        FROM (SELECT DISTINCT name FROM runs UNION ALL SELECT DISTINCT lang FROM documents) n
        LEFT JOIN (
          SELECT name, version, run_id FROM decided WHERE promoted
          QUALIFY row_number() OVER (PARTITION BY name ORDER BY version DESC) = 1
        ) v USING (name)"""
    ),
    "run_name": _runs(
        """SELECT run_id, concat(name, ' ', strftime(date_trunc('second', logged_at), '%Y-%m-%d %H:%M:%S'))
          AS run_name FROM runs"""
    ),
    **{
        name: _clean("SELECT class, count(*) AS n_rows, true AS known, true AS learnt FROM news_clean GROUP BY class")
        for name in ("train_logreg", "train_sharded")
    },
    "grid_search": " UNION ALL ".join(
        f"""SELECT {i}::BIGINT AS candidate_id, {", ".join(f"'{v}' AS {n}" for n, v in c.items())},
          true AS scored, true AS ranked, true AS below_first"""
        for i, c in enumerate(candidates())
    ),
    "predict": _split("SELECT row_id, class, true AS known FROM split_rows WHERE split = 'test'"),
    "predict_proba": _split(
        "SELECT row_id, CAST(1.0 AS DOUBLE) AS probability_sum, true AS likeliest FROM split_rows WHERE split = 'test'"
    ),
    "evaluate_model": _split(
        """SELECT coalesce(class, label) AS label, count(*) AS support,
          CASE WHEN label <> 'accuracy' THEN true END AS precision, CASE WHEN label <> 'accuracy' THEN true END AS recall, true AS f1_score
        FROM (SELECT unnest(['class', 'accuracy', 'macro avg', 'weighted avg']) AS label, CASE WHEN label = 'class' THEN class END AS class
          FROM split_rows WHERE split = 'test') GROUP BY label, class"""
    ),
    "model_save": """SELECT 'linear' AS name, version, concat('run-', score) AS run_id,
          '{"input": "input_text string"}' AS signature, score AS test_f1_score
        FROM (VALUES (1::BIGINT, 0.5::DOUBLE), (2, 0.6)) v(version, score)""",
    "model_load": _split("SELECT row_id, class, true AS known FROM split_rows WHERE split = 'test'"),
    "train_and_promote": """SELECT name, 'production' AS alias, 1::BIGINT AS version, true AS scored
        FROM (VALUES ('linear'), ('encoder')) v(name)""",
    "serve_requests": _served("2"),
    "stream_serve": _served("CASE WHEN CAST(split_part(request_id, '-', 1) AS BIGINT) % 2 = 0 THEN 1 ELSE 2 END"),
    "request_types": f"""WITH b AS (SELECT concat(conv_id, '-', turn) AS request_id, conv_id % 8 AS kind, text FROM conversations)
        SELECT CASE WHEN kind <> 5 THEN request_id END AS request_id, 'request_failed' AS error,
          CASE kind WHEN 0 THEN '{TEXT_TYPE}' WHEN 6 THEN '{TEXT_TYPE}' WHEN 5 THEN 'body is not valid JSON'
            ELSE '{TEXTS_TYPE}' END AS detail, 422 AS status
        FROM b WHERE kind NOT IN (3, 4, 7)""",
    "fold_frequencies": _terms(
        f"""SELECT term, {', '.join(f"count(*) FILTER (fold = {i}) AS f{i}" for i in range(FOLDS))},
          CAST(len(string_split(term, ' ')) AS BIGINT) AS words
        FROM (SELECT DISTINCT row_id, unnest({_BIGRAMS}) AS term FROM tokens) JOIN folds USING (row_id) GROUP BY term""",
        _FOLDS,
    ),
    "stream_score": _SCORED_REQUESTS,
    "stream_reject": _requests(f"{_REQUEST_INVALID} UNION ALL {_request_no_text(valid_only=True)}"),
    **{
        name: _clean(
            """SELECT CAST(date_trunc('day', date) AS DATE) AS bucket, class, count(*) AS n_rows
            FROM passing GROUP BY 1, 2"""
        )
        for name in ("stream_trend", "stream_trend_late")
    },
    "stream_clean": _STREAM_CLEAN,
    "stream_dedup": _clean("SELECT DISTINCT title, text, class FROM passing"),
}
