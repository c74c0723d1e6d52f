"""DuckDB oracle SQL for the registered queries.

Each statement recomputes a query from the raw driver tables with plain
SQL (windows, self-joins and brute force are fine here: this is the
reference answer on small data, not the production plan).  Fixture
derivations repeat ``spreadlens.sources.fixtures`` clause by clause.
"""

from __future__ import annotations

import math

from ..functions.text import DOMAIN_PATTERNS, LABEL_ORDER, VALID_DOMAINS

LINEITEM_FEATURES = ["quantity", "extendedprice", "discount", "tax"]
GEO = ["D_cos", "D_cos_var", "D_pair", "sig2_S"]


def md5i(*parts: str) -> str:
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 7))::BIGINT"


def md5u(*parts: str) -> str:
    return f"({md5i(*parts)} / 268435456.0)"


def rnd(sql: str, cols: list[str], digits: int = 6) -> str:
    rep = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _r"


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ------------------------------------------------------------------ fixtures

RESPONSES = f"""responses_fx AS (
  SELECT d.source || '_' || d.lang || '_' || CAST(d.doc_id AS VARCHAR) AS id,
         d.source || '_' || d.lang AS prompt_id,
         d.doc_id,
         'ds' || CAST(CAST(substr(d.source, 4, 10) AS INTEGER) % 5 AS VARCHAR) AS dataset,
         d.lang AS topic_label,
         'Which passage comes from ' || d.source || ' in ' || d.lang || '?' AS question,
         d.source AS reference_answer,
         d.text AS model_answer,
         CAST(1.0 AS DOUBLE) AS temperature,
         d.lang AS type,
         ({sql_list(VALID_DOMAINS)})[CAST({md5i("'dom'", "d.doc_id")} % 5 + 1 AS INTEGER)] AS domain,
         CASE WHEN l.quality = 1 THEN 'correct' WHEN l.quality = 0 THEN 'incorrect'
              WHEN d.u < 0.40 THEN 'correct' WHEN d.u < 0.70 THEN 'incorrect'
              WHEN d.u < 0.90 THEN 'refused' WHEN d.u < 0.95 THEN 'error' ELSE 'unknown' END AS correctness,
         COALESCE(l.toxic = 1, false) AS adversarial,
         CAST({md5i("'score'", "d.doc_id")} % 5 + 1 AS INTEGER) AS correctness_score,
         CAST(length(d.text) AS INTEGER) AS answer_len
  FROM (SELECT *, {md5u("'resp'", "doc_id")} AS u FROM documents) d
  LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def text_vec(name: str = "text_vec", dims: int = 64) -> list[str]:
    p = name + "_"
    return [
        f"{p}tok AS (SELECT id, unnest(string_split_regex(lower(model_answer), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM responses_fx)",
        f"{p}cnt AS (SELECT id, CAST({md5i('t')} % {dims} AS INTEGER) AS pos, CAST(count(*) AS DOUBLE) AS c "
        f"FROM {p}tok WHERE t <> '' GROUP BY ALL)",
        f"{p}nrm AS (SELECT id, sqrt(sum(c * c)) AS nrm FROM {p}cnt GROUP BY id)",
        f"{name} AS (SELECT r.dataset, r.prompt_id, c.id, c.pos, c.c / greatest(n.nrm, 1e-12) AS v "
        f"FROM {p}cnt c JOIN {p}nrm n ON c.id = n.id JOIN responses_fx r ON r.id = c.id "
        f"UNION ALL SELECT dataset, prompt_id, id, 0, 0.0 FROM responses_fx WHERE id NOT IN (SELECT id FROM {p}nrm))",
    ]


DENSE_VEC = """dense_vec AS (
  SELECT dataset, prompt_id, id, pos, v / greatest(nrm, 1e-12) AS v FROM (
    SELECT 'ds' || CAST(label % 3 AS VARCHAR) AS dataset, 'v' || CAST(label AS VARCHAR) AS prompt_id,
           CAST(vec_id AS VARCHAR) AS id,
           unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v,
           sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm
    FROM embeddings))"""

LI_ROWS = """li_rows AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS row_id,
         l_linestatus AS dataset, CAST(l_returnflag = 'R' AS INTEGER) AS y,
         l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax
  FROM lineitem)"""

LI_LONG = """li_long AS (
  SELECT dataset, row_id, y AS label, 'quantity' AS feature, quantity AS value FROM li_rows
  UNION ALL SELECT dataset, row_id, y, 'extendedprice', extendedprice FROM li_rows
  UNION ALL SELECT dataset, row_id, y, 'discount', discount FROM li_rows
  UNION ALL SELECT dataset, row_id, y, 'tax', tax FROM li_rows)"""

PREDS = f"""preds AS (
  SELECT row_id, dataset, y AS y_true, round(({md5u("'pred'", "row_id")} + y) / 2.0, 3) AS y_prob FROM li_rows)"""

EIGEN = """eigen AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, 'ds' || CAST(label % 3 AS VARCHAR) AS dataset,
         CAST(label >= 5 AS INTEGER) AS label,
         CAST(pos // 16 AS INTEGER) AS layer, CAST((pos % 16) // 4 AS INTEGER) AS head,
         CAST(pos % 4 + 1 AS INTEGER) AS rank, CAST(eig AS DOUBLE) AS eig
  FROM (SELECT vec_id, label, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS eig FROM embeddings))"""

ATTENTION = """att_tok AS (SELECT vec_id // 8 AS seq, CAST(vec_id % 8 AS INTEGER) AS pos, embedding FROM embeddings),
att_pairs AS (
  SELECT q.seq, s.s, q.pos AS i, k.pos AS j,
         exp(4.0 * (SELECT sum(CAST(q.embedding[d + 1] AS DOUBLE) * CAST(k.embedding[d + 1] AS DOUBLE))
                    FROM range(s.s * 16, s.s * 16 + 16) r(d))) AS w
  FROM att_tok q JOIN att_tok k ON q.seq = k.seq AND k.pos <= q.pos
  CROSS JOIN (SELECT unnest(range(0, 4)) AS s) s),
attention AS (
  SELECT 'seq' || CAST(seq AS VARCHAR) AS id, CAST(s // 2 AS INTEGER) AS layer, CAST(s % 2 AS INTEGER) AS head,
         i, j, w / sum(w) OVER (PARTITION BY seq, s, i) AS a
  FROM att_pairs)"""

ATT_LABELS = """att_labels AS (
  SELECT 'seq' || CAST(vec_id // 8 AS VARCHAR) AS id, 'ds' || CAST((vec_id // 8) % 3 AS VARCHAR) AS dataset,
         CAST(avg(label) >= 4.5 AS INTEGER) AS label
  FROM embeddings GROUP BY vec_id // 8)"""

PARAPHRASE = """para AS (SELECT p_partkey AS row_id, p_brand AS answer, p_name AS question, p_type AS domain FROM part)"""


def judge_raw_cte() -> str:
    k = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
    word = "CASE event_type WHEN 'click' THEN 'Correct' WHEN 'view' THEN 'INCORRECT' ELSE 'refused' END"
    full = ("'{\"correctness\": \"' || " + word + " || '\", \"domain\": \"STEM\", \"adversarial\": ' || "
            "CASE WHEN value > 10 THEN 'true' ELSE 'false' END || ', \"correctness_score\": ' || "
            f"CAST(({k} % 5) + 1 AS VARCHAR) || '}}'")
    content = ("CASE WHEN event_type = 'error' THEN '{\"correctness\": \"incorrect\", \"domain\": \"STEM\", \"adversarial\": tru' "
               f"WHEN event_type = 'signup' THEN '{{\"domain\": \"Humanities\", \"correctness_score\": ' || CAST({k} AS VARCHAR) || '}}' "
               "WHEN event_id % 97 = 0 THEN '{\"correctness\": \"correct\", \"adversarial\": \"true\", \"correctness_score\": \"4\"}' "
               "WHEN event_id % 89 = 0 THEN '{\"correctness\": null, \"domain\": \"STEM\", \"correctness_score\": 4.0}' "
               "WHEN event_id % 83 = 0 THEN '[\"correct\"]' "
               f"ELSE {full} END")
    return f"judge_raw AS (SELECT event_id AS id, {content} AS content FROM events)"


JUDGE_PARSED = """judge_parsed AS (
  SELECT id,
         CASE WHEN bad THEN 'error'
              ELSE lower(coalesce(json_extract_string(content, '$.correctness'), 'unknown')) END AS correctness,
         CASE WHEN bad THEN 'error'
              ELSE coalesce(json_extract_string(content, '$.domain'), 'unknown') END AS domain,
         CASE WHEN bad THEN false
              ELSE coalesce(lower(json_extract_string(content, '$.adversarial')) = 'true', false) END AS adversarial,
         CASE WHEN bad THEN -1
              ELSE coalesce(CAST(floor(TRY_CAST(json_extract_string(content, '$.correctness_score') AS DOUBLE)) AS INTEGER), -1) END AS correctness_score
  FROM (SELECT *, NOT (json_valid(content) AND json_type(CASE WHEN json_valid(content) THEN content END) = 'OBJECT') AS bad FROM judge_raw))"""


def geometry(prefix: str, vec: str) -> list[str]:
    """Brute-force G1–G4 from a long vector table (prompt_id, id, pos, v)."""
    p = prefix
    return [
        f"{p}n AS (SELECT prompt_id, count(DISTINCT id) AS n FROM {vec} GROUP BY prompt_id)",
        f"{p}c AS (SELECT prompt_id, pos, sum(v) AS s FROM {vec} GROUP BY prompt_id, pos)",
        f"{p}r AS (SELECT c.prompt_id, sqrt(sum((c.s / n.n) * (c.s / n.n))) AS r FROM {p}c c "
        f"JOIN {p}n n ON c.prompt_id = n.prompt_id GROUP BY c.prompt_id)",
        f"{p}p AS (SELECT v.prompt_id, v.id, sum(v.v * (c.s / n.n) / (r.r + 1e-12)) AS proj FROM {vec} v "
        f"JOIN {p}c c ON v.prompt_id = c.prompt_id AND v.pos = c.pos JOIN {p}n n ON v.prompt_id = n.prompt_id "
        f"JOIN {p}r r ON v.prompt_id = r.prompt_id GROUP BY v.prompt_id, v.id)",
        f"{p}ids AS (SELECT DISTINCT prompt_id, id FROM {vec})",
        f"{p}dot AS (SELECT a.prompt_id, a.id AS i, b.id AS j, sum(a.v * b.v) AS s FROM {vec} a JOIN {vec} b "
        f"ON a.prompt_id = b.prompt_id AND a.pos = b.pos AND a.id < b.id GROUP BY ALL)",
        f"{p}pairs AS (SELECT a.prompt_id, coalesce(d.s, 0.0) AS s FROM {p}ids a JOIN {p}ids b "
        f"ON a.prompt_id = b.prompt_id AND a.id < b.id LEFT JOIN {p}dot d ON d.prompt_id = a.prompt_id "
        f"AND d.i = a.id AND d.j = b.id)",
        f"{p}ps AS (SELECT prompt_id, 1 - avg(s) AS D_pair, var_pop(s) AS sig2_S FROM {p}pairs GROUP BY prompt_id)",
        f"{p}geo AS (SELECT p.prompt_id, n.n, 1 - avg(p.proj) AS D_cos, var_pop(p.proj) AS D_cos_var, "
        f"ps.D_pair, ps.sig2_S FROM {p}p p JOIN {p}n n ON p.prompt_id = n.prompt_id "
        f"LEFT JOIN {p}ps ps ON ps.prompt_id = p.prompt_id GROUP BY p.prompt_id, n.n, ps.D_pair, ps.sig2_S)",
    ]


COUNTS = """qc0 AS (
  SELECT prompt_id, count(*) AS n_samples,
         CAST(sum(CASE WHEN lower(correctness) = 'correct' THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
         CAST(sum(CASE WHEN lower(correctness) = 'incorrect' THEN 1 ELSE 0 END) AS BIGINT) AS n_incorrect,
         CAST(sum(CASE WHEN lower(correctness) = 'refused' THEN 1 ELSE 0 END) AS BIGINT) AS n_refused,
         avg(correctness_score) AS score_mean, stddev_pop(correctness_score) AS score_std,
         avg(answer_len) AS len_mean, stddev_pop(answer_len) AS len_std
  FROM responses_fx GROUP BY prompt_id),
qcounts AS (
  SELECT *, n_correct + n_incorrect AS n_definitive,
         n_correct / n_samples AS frac_correct, n_incorrect / n_samples AS frac_incorrect,
         n_refused / n_samples AS frac_refused,
         CASE WHEN n_correct + n_incorrect > 0 THEN n_incorrect / (n_correct + n_incorrect) ELSE 1.0 END AS hall_rate_strict,
         (n_incorrect + n_refused) / n_samples AS hall_rate_merged,
         (n_incorrect + n_refused) / n_samples AS p_halluc,
         CAST((n_incorrect + n_refused) / n_samples > 0.5 AS INTEGER) AS label
  FROM qc0 WHERE n_correct + n_incorrect > 0)"""

COUNT_DOUBLES = ["score_mean", "score_std", "len_mean", "len_std", "frac_correct", "frac_incorrect",
                 "frac_refused", "hall_rate_strict", "hall_rate_merged", "p_halluc"]

META = """qm0 AS (
  SELECT prompt_id, arg_min(question, id) AS question, arg_min(reference_answer, id) AS reference_answer,
         arg_min(dataset, id) AS dataset, arg_min(adversarial, id) AS adversarial, arg_min(type, id) AS type,
         count(DISTINCT domain) AS n_unique_domains
  FROM responses_fx GROUP BY prompt_id),
qmode AS (
  SELECT prompt_id, domain AS domain_mode FROM (
    SELECT prompt_id, domain, row_number() OVER (PARTITION BY prompt_id ORDER BY cnt DESC, domain) AS rk
    FROM (SELECT prompt_id, domain, count(*) AS cnt FROM responses_fx WHERE domain IS NOT NULL GROUP BY ALL))
  WHERE rk = 1),
qmeta AS (SELECT m.*, d.domain_mode, m.n_unique_domains > 1 AS domain_inconsistent
          FROM qm0 m LEFT JOIN qmode d ON m.prompt_id = d.prompt_id)"""

QTABLE = [RESPONSES, META, COUNTS] + text_vec() + geometry("tg_", "text_vec") + [
    """qtable AS (
  SELECT m.prompt_id, m.dataset, m.domain_mode AS domain, m.domain_inconsistent, m.adversarial,
         c.* EXCLUDE (prompt_id), round(g.D_cos, 9) AS D_cos, round(g.D_cos_var, 9) AS D_cos_var, round(g.D_pair, 9) AS D_pair,
         round(g.sig2_S, 9) AS sig2_S
  FROM qmeta m JOIN qcounts c ON m.prompt_id = c.prompt_id JOIN tg_geo g ON g.prompt_id = m.prompt_id)"""]


def ks_pvalue(d: str, n1: str, n0: str) -> str:
    z = f"({d} * sqrt(CAST({n1} AS DOUBLE) * {n0} / ({n1} + {n0})))"
    series = (f"list_sum(list_transform(range(1, 101), lambda m: "
              f"(CASE WHEN m % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * m * m * {z} * {z})))")
    return f"(CASE WHEN {z} < 0.05 THEN 1.0 ELSE least(1.0, greatest(0.0, 2.0 * {series})) END)"


def normal_sf(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * {x}))"
    poly = (f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))))")
    upper = f"(0.5 * {poly} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN {upper} ELSE 1.0 - {upper} END)"


def stars(p: str) -> str:
    return f"(CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE 'ns' END)"


def ks_sql(src: str, keys: list[str], n_tests: int, alpha: float = 0.05) -> list[str]:
    k = ", ".join(keys)
    on = " AND ".join(f"cc.{c} = t.{c}" for c in keys)
    return [
        f"ks_c AS (SELECT {k}, CAST(value AS DOUBLE) AS score, sum(label) AS c1, sum(1 - label) AS c0 FROM {src} "
        f"WHERE value IS NOT NULL AND label IS NOT NULL GROUP BY ALL)",
        f"ks_cc AS (SELECT *, sum(c1) OVER w AS cum1, sum(c0) OVER w AS cum0 FROM ks_c "
        f"WINDOW w AS (PARTITION BY {k} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
        f"ks_t AS (SELECT {k}, CAST(sum(c1) AS BIGINT) AS n1, CAST(sum(c0) AS BIGINT) AS n0 FROM ks_c GROUP BY ALL)",
        f"ks_d AS (SELECT {', '.join('t.' + c for c in keys)}, t.n1, t.n0, max(abs(cum1 / t.n1 - cum0 / t.n0)) AS ks_stat "
        f"FROM ks_cc cc JOIN ks_t t ON {on} WHERE t.n1 >= 2 AND t.n0 >= 2 GROUP BY ALL)",
        f"ks AS (SELECT *, {ks_pvalue('ks_stat', 'n1', 'n0')} AS p_value FROM ks_d)",
        f"ks_out AS (SELECT *, {stars('p_value')} AS sig, p_value < {alpha / n_tests!r} AS significant FROM ks)",
    ]


def auc_sql(src: str, keys: list[str], score: str, label: str, name: str = "auc") -> list[str]:
    k = ", ".join(keys)
    part = f"PARTITION BY {k} " if keys else ""
    grp = f"GROUP BY {k}" if keys else ""
    sel = f"{k}, " if keys else ""
    return [
        f"{name}_c AS (SELECT {sel}CAST({score} AS DOUBLE) AS score, sum({label}) AS c1, sum(1 - {label}) AS c0 "
        f"FROM {src} WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY ALL)",
        f"{name}_cc AS (SELECT *, sum(c0) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum0 "
        f"FROM {name}_c)",
        f"{name} AS (SELECT {sel}CAST(sum(c1) AS BIGINT) AS n1, CAST(sum(c0) AS BIGINT) AS n0, "
        f"CASE WHEN sum(c1) > 0 AND sum(c0) > 0 THEN sum(c1 * (cum0 - 0.5 * c0)) / (sum(c1) * sum(c0)) END AS auc "
        f"FROM {name}_cc {grp})",
    ]


def ap_sql(src: str, keys: list[str], score: str, label: str) -> list[str]:
    k = ", ".join(keys)
    return [
        f"ap_c AS (SELECT {k}, CAST({score} AS DOUBLE) AS score, sum({label}) AS c1, sum(1 - {label}) AS c0 "
        f"FROM {src} GROUP BY ALL)",
        f"ap_cc AS (SELECT *, sum(c1) OVER w AS tp, sum(c0) OVER w AS fp FROM ap_c "
        f"WINDOW w AS (PARTITION BY {k} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
        f"ap AS (SELECT {k}, CASE WHEN sum(c1) > 0 THEN sum(c1 * tp / (tp + fp)) / sum(c1) END AS average_precision "
        f"FROM ap_cc GROUP BY {k})",
    ]


def domain_case(col: str) -> str:
    """B1 in RE2: Python's Unicode-aware word boundary spelled out."""
    parts = []
    for name, pat in DOMAIN_PATTERNS:
        body = pat.replace("(?i)", "")
        alts = []
        for alt in body.split("|"):
            a = alt
            if a.startswith("\\b"):
                a = "(^|[^\\p{L}\\p{N}_])" + a[2:]
            if a.endswith("\\b"):
                a = a[:-2] + "([^\\p{L}\\p{N}_]|$)"
            alts.append(a)
        rx = "(?i)(" + "|".join(alts) + ")"
        parts.append(f"WHEN regexp_matches({col}, '{rx}') THEN '{name}'")
    return "(CASE " + " ".join(parts) + " ELSE 'Other' END)"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


# ------------------------------------------------------------------ statements

def build() -> dict[str, str]:
    O: dict[str, str] = {}

    O["responses_loaded"] = with_([RESPONSES] + text_vec(), """
      SELECT r.id, regexp_replace(r.id, '_[^_]*$', '') AS prompt_id, dataset, domain, correctness, adversarial,
             correctness_score, answer_len, r.id IN (SELECT id FROM text_vec) AS has_vector
      FROM responses_fx r""")

    O["responses_jsonl"] = with_([RESPONSES], """
      SELECT id, regexp_replace(id, '_[^_]*$', '') AS prompt_id, dataset, correctness, adversarial, correctness_score, answer_len FROM responses_fx""")

    O["vector_map"] = rnd("""
      SELECT vec_id, label, len(embedding) AS n, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS total,
             sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm
      FROM embeddings WHERE embedding IS NOT NULL""", ["total", "norm"])

    O["union_datasets"] = with_([RESPONSES], """
      SELECT id, dataset, answer_len, CAST(NULL AS VARCHAR) AS correctness FROM responses_fx WHERE dataset = 'ds0'
      UNION ALL SELECT id, dataset, CAST(NULL AS INTEGER), correctness FROM responses_fx WHERE dataset <> 'ds0'""")

    O["domain_canonical"] = with_([RESPONSES], f"""
      SELECT d.doc_id, {domain_case('d.text')} AS text_domain, {domain_case('r.domain')} AS label_domain
      FROM documents d JOIN responses_fx r ON d.doc_id = r.doc_id""")

    boxed = "CASE WHEN regexp_matches(text, '\\\\boxed\\{(.+?)\\}') THEN regexp_extract(text, '\\\\boxed\\{(.+?)\\}', 1) ELSE text END"
    hashes = f"CASE WHEN contains(text, '####') THEN {py_strip(chr(40) + 'string_split(text, ' + chr(39) + '####' + chr(39) + ')[-1]' + chr(41))} ELSE text END"
    first_line = f"split_part({py_strip('text')}, chr(10), 1)"
    clean = py_strip(f"split_part({first_line}, 'Question:', 1)")
    O["answer_extract"] = f"""
      SELECT conv_id, turn, form, md5({boxed}) AS boxed_md5, md5({hashes}) AS hashes_md5, {clean} AS clean FROM (
        SELECT conv_id, turn, unnest(range(0, 4))::INTEGER AS form, unnest([text, text || chr(10) || '#### ' || h || ' ' || chr(10),
               'so \\boxed{{' || h || '}} and \\boxed{{2}}', chr(10) || ' ' || h || ' Question: ' || text]) AS text
        FROM (SELECT *, split_part(text, ' ', 1) AS h FROM conversations))"""

    from ..functions import text as TX

    def fill(template: str, values: dict) -> str:
        out, rest = [], template
        while True:
            starts = [(rest.find("{" + k + "}"), k) for k in values if ("{" + k + "}") in rest]
            if not starts:
                out.append("'" + rest.replace("'", "''") + "'")
                break
            pos, key = min(starts)
            out.append("'" + rest[:pos].replace("'", "''") + "'")
            out.append(f"coalesce(CAST({values[key]} AS VARCHAR), 'None')")
            rest = rest[pos + len(key) + 2:]
        return "(" + " || ".join(out) + ")"

    fam = "CASE WHEN topic_label = 'en' THEN 'mmlu' WHEN topic_label = 'fr' THEN 'math' ELSE 'factual' END"
    mmlu = fill(TX.PROMPT_MMLU, {"question": "question", "choice_a": "reference_answer", "choice_b": "topic_label",
                                 "choice_c": "dataset", "choice_d": "domain"})
    prompt = (f"CASE WHEN {fam} = 'mmlu' THEN {mmlu} WHEN {fam} = 'math' THEN {fill(TX.PROMPT_MATH, {'question': 'question'})} "
              f"ELSE {fill(TX.PROMPT_FACTUAL, {'question': 'question'})} END")
    judge = fill(TX.JUDGE_PROMPT, {"question": "question", "reference": "reference_answer", "model_answer": "model_answer"})
    O["prompt_render"] = with_([RESPONSES], f"""
      SELECT id, md5({prompt}) AS prompt_md5, md5({judge}) AS judge_md5,
             CASE WHEN dataset = 'ds0' THEN coalesce(type, '') ELSE '' END AS type_field FROM responses_fx""")

    O["judge_parse"] = with_([judge_raw_cte(), JUDGE_PARSED], "SELECT * FROM judge_parsed")

    O["judge_binary"] = f"""
      SELECT event_id, CASE WHEN {py_strip("CASE WHEN event_type = 'error' THEN '  ' ELSE event_type END")} = '' THEN 1
                            WHEN CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS VARCHAR) = '0' THEN 0
                            ELSE 1 END AS label
      FROM events"""

    O["identity_keys"] = with_([RESPONSES], """
      SELECT doc_id, new_pid AS new_prompt_id, new_pid || '_ans' || lpad(CAST(ai - 1 AS VARCHAR), 2, '0') AS new_id,
             'sample' || lpad(CAST(ai - 1 AS VARCHAR), 2, '0') AS sample_num
      FROM (SELECT doc_id, dataset || '_' || lpad(CAST(qi - 1 AS VARCHAR), 5, '0') || '_t' || CAST(temperature AS VARCHAR) AS new_pid,
                   row_number() OVER (PARTITION BY prompt_id ORDER BY doc_id) AS ai
            FROM (SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY prompt_id) AS qi FROM responses_fx))""")

    O["pending_rows"] = with_([judge_raw_cte(), JUDGE_PARSED], """
      SELECT id, CAST(NULL AS INTEGER) AS label, true AS pending FROM judge_parsed
      WHERE correctness_score IS NULL OR correctness_score = -1
      UNION ALL
      SELECT id, CAST(lower(correctness) = 'incorrect' AS INTEGER), false FROM judge_parsed WHERE correctness <> 'error'""")

    O["p_hat_bands"] = rnd(with_([RESPONSES, COUNTS], """
      SELECT prompt_id, p_halluc,
             CASE WHEN p_halluc < 0.2 THEN 'low' WHEN p_halluc > 0.3 AND p_halluc <= 0.6 THEN 'mid'
                  WHEN p_halluc >= 0.9 THEN 'high' END AS band_a,
             CASE WHEN p_halluc < 0.4 THEN 'low' WHEN p_halluc <= 0.65 THEN 'mid' ELSE 'high' END AS band_b
      FROM qcounts"""), ["p_halluc"])

    sq = "lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)"
    O["vector_ops"] = rnd(f"""
      SELECT e.vec_id, sqrt(list_sum(list_transform(e.embedding, {sq}))) AS norm,
             sqrt(list_sum(list_transform(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) /
                  greatest(sqrt(list_sum(list_transform(e.embedding, {sq}))), 1e-12)), lambda y: y * y))) AS unit_norm,
             CASE WHEN n.embedding IS NULL THEN NULL ELSE
               list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(n.embedding[i] AS DOUBLE)))
               / greatest(sqrt(list_sum(list_transform(e.embedding, {sq}))) * sqrt(list_sum(list_transform(n.embedding, {sq}))), 1e-12) END AS cos_next,
             list_sum(list_transform(e.embedding, lambda x: sign(CAST(x AS DOUBLE)) * ln(1 + abs(CAST(x AS DOUBLE))))) AS slog_sum
      FROM embeddings e LEFT JOIN embeddings n ON n.vec_id - 1 = e.vec_id""", ["norm", "unit_norm", "cos_next", "slog_sum"])

    O["eigen_index"] = rnd("""
      SELECT vec_id, CAST(pos AS INTEGER) AS pos, CAST(pos // 16 AS INTEGER) AS layer, CAST((pos % 16) // 4 AS INTEGER) AS head,
             CAST(pos % 4 + 1 AS INTEGER) AS rank, CAST(v AS DOUBLE) AS v
      FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings)""", ["v"])

    O["join_eigen_meta"] = rnd(with_([EIGEN], """
      SELECT v.id, m.dataset, m.label, v.dim, v.f_first, v.f_last FROM (
        SELECT id, CAST(count(*) AS INTEGER) AS dim, arg_min(eig, layer * 16 + head * 4 + rank) AS f_first,
               arg_max(eig, layer * 16 + head * 4 + rank) AS f_last FROM eigen GROUP BY id) v
      JOIN (SELECT DISTINCT id, dataset, label FROM eigen) m ON v.id = m.id WHERE v.dim = 64"""),
        ["f_first", "f_last"])

    O["join_question_geometry"] = rnd(with_(QTABLE, "SELECT * FROM qtable"), COUNT_DOUBLES + GEO)

    O["join_targets_left"] = rnd(with_([PARAPHRASE], """
      SELECT f.class_id, f.n_domains, t.n_wrong, t.n, t.p_hat, t.y FROM
        (SELECT answer AS class_id, count(DISTINCT domain) AS n_domains FROM para GROUP BY answer) f
      LEFT JOIN (SELECT answer AS class_id, CAST(sum(CAST(domain = 'ECONOMY' AS INTEGER)) AS BIGINT) AS n_wrong, count(*) AS n,
                        sum(CAST(domain = 'ECONOMY' AS INTEGER)) / count(*) AS p_hat,
                        CAST(sum(CAST(domain = 'ECONOMY' AS INTEGER)) >= 20 AS INTEGER) AS y
                 FROM para GROUP BY answer HAVING sum(CAST(domain = 'ECONOMY' AS INTEGER)) > 10) t
      ON f.class_id = t.class_id"""), ["p_hat"])

    O["resume_anti"] = with_([RESPONSES], """
      SELECT id, prompt_id FROM responses_fx r WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.doc_id)""")

    O["semi_selected"] = with_([PARAPHRASE], """
      SELECT row_id, answer, question FROM para WHERE answer IN (
        SELECT answer FROM para GROUP BY answer HAVING count(DISTINCT question) = 47)""")

    O["lookup_majority_domain"] = with_([RESPONSES], f"""
      SELECT r.id, m.clean_domain FROM responses_fx r LEFT JOIN (
        SELECT question, domain AS clean_domain FROM (
          SELECT question, domain, row_number() OVER (PARTITION BY question ORDER BY cnt DESC, domain) AS rk
          FROM (SELECT question, domain, count(*) AS cnt FROM responses_fx
                WHERE correctness NOT IN ('error', 'unknown') AND domain IN ('STEM', 'Humanities', 'Social Sciences',
                      'Medicine & Health', 'Law, Business, and Miscellaneous') GROUP BY ALL)) WHERE rk = 1) m
      ON r.question = m.question""")

    O["upsert_judgements"] = with_([RESPONSES], """
      SELECT id, CASE WHEN correctness IN ('error', 'unknown') THEN
                   CASE WHEN answer_len % 2 = 0 THEN 'correct' ELSE 'incorrect' END ELSE correctness END AS correctness,
             CASE WHEN correctness IN ('error', 'unknown') THEN 3 ELSE correctness_score END AS correctness_score
      FROM responses_fx""")

    O["matched_pairs_corr"] = rnd(with_(
        [RESPONSES] + text_vec("tva", 64) + text_vec("tvb", 32) + geometry("ga_", "tva") + geometry("gb_", "tvb") + [
            """mp AS (SELECT a.prompt_id, round(a.D_cos, 9) AS a, round(b.D_cos, 9) AS b FROM ga_geo a JOIN gb_geo b ON a.prompt_id = b.prompt_id)""",
            """mpr AS (SELECT *, (rank() OVER (ORDER BY a) + rank() OVER (ORDER BY a) + count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
                             (rank() OVER (ORDER BY b) + rank() OVER (ORDER BY b) + count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM mp)"""],
        "SELECT corr(a, b) AS pearson, corr(ra, rb) AS spearman, count(*) AS n FROM mpr"), ["pearson", "spearman"])

    O["question_metadata"] = with_([RESPONSES, META], "SELECT * FROM qmeta")
    O["question_counts"] = rnd(with_([RESPONSES, COUNTS], "SELECT * FROM qcounts"), COUNT_DOUBLES)

    O["skipped_questions"] = """
      WITH alt AS (SELECT d.source || '_' || d.lang AS prompt_id, d.lang AS domain,
                          CASE WHEN l.quality IS NULL THEN 'refused' WHEN l.quality = 1 THEN 'correct' ELSE 'incorrect' END AS c
                   FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
      sk AS (SELECT prompt_id FROM alt GROUP BY prompt_id
             HAVING sum(CASE WHEN c IN ('correct', 'incorrect') THEN 1 ELSE 0 END) = 0),
      md AS (SELECT prompt_id, domain FROM (
               SELECT prompt_id, domain, row_number() OVER (PARTITION BY prompt_id ORDER BY cnt DESC, domain) AS rk
               FROM (SELECT prompt_id, domain, count(*) AS cnt FROM alt GROUP BY ALL)) WHERE rk = 1)
      SELECT md.domain, count(*) AS n_skipped FROM sk JOIN md ON sk.prompt_id = md.prompt_id GROUP BY md.domain"""

    O["questions_per_domain"] = with_([RESPONSES], "SELECT domain, count(DISTINCT prompt_id) AS n_questions FROM responses_fx GROUP BY domain")
    O["split_domains"] = with_(QTABLE, "SELECT domain, count(*) AS n_questions, count(*) >= 15 AS in_analysis FROM qtable GROUP BY domain")

    O["loading_summary"] = rnd(with_([RESPONSES], """
      SELECT (SELECT count(*) FROM responses_fx) AS n_rows,
             (SELECT count(DISTINCT prompt_id) FROM responses_fx) AS n_questions,
             (SELECT count(DISTINCT domain) FROM responses_fx) AS n_domains,
             min(spq) AS spq_min, max(spq) AS spq_max, CAST(median(spq) AS DOUBLE) AS spq_median
      FROM (SELECT prompt_id, count(*) AS spq FROM responses_fx GROUP BY prompt_id)"""), ["spq_median"])

    O["label_distribution"] = rnd(with_([RESPONSES], """
      SELECT correctness, count(*) AS n, round(count(*) / (SELECT count(*) FROM responses_fx) * 100, 1) AS pct
      FROM responses_fx GROUP BY correctness"""), ["pct"])

    O["domain_consistency"] = rnd(with_([RESPONSES, META], """
      SELECT CAST(sum(CAST(domain_inconsistent AS INTEGER)) AS BIGINT) AS n_inconsistent, count(*) AS n_questions,
             avg(CAST(domain_inconsistent AS DOUBLE)) AS inconsistency_rate, max(n_unique_domains) AS max_unique_domains
      FROM qmeta"""), ["inconsistency_rate"])

    O["filtering_diagnostic"] = with_(QTABLE, """
      SELECT coalesce(r.domain, s.domain) AS domain, coalesce(s.n_surviving, 0) AS n_surviving, coalesce(r.n_raw, 0) AS n_raw,
             coalesce(r.n_raw, 0) - coalesce(s.n_surviving, 0) AS n_dropped, coalesce(s.n_surviving, 0) < 15 AS below_threshold
      FROM (SELECT domain_mode AS domain, count(*) AS n_raw FROM qmeta GROUP BY domain_mode) r
      FULL OUTER JOIN (SELECT domain, count(*) AS n_surviving FROM qtable GROUP BY domain) s ON r.domain = s.domain""")

    cols = ", ".join(f"CASE WHEN tot = 0 THEN 0.0 ELSE n_{c} / tot END AS {c}" for c in LABEL_ORDER)
    sums = ", ".join(f"sum(CASE WHEN correctness = '{c}' THEN 1 ELSE 0 END) AS n_{c}" for c in LABEL_ORDER)
    O["crosstab_domain_correctness"] = rnd(with_([RESPONSES], f"""
      SELECT domain, {cols} FROM (SELECT domain, {sums}, {' + '.join(f"sum(CASE WHEN correctness = '{c}' THEN 1 ELSE 0 END)" for c in LABEL_ORDER)} AS tot
      FROM responses_fx GROUP BY domain)"""), LABEL_ORDER)

    O["label_fractions_by_domain"] = rnd(with_(QTABLE, """
      SELECT domain, avg(frac_correct) AS frac_correct, avg(frac_incorrect) AS frac_incorrect, avg(frac_refused) AS frac_refused
      FROM qtable GROUP BY domain"""), ["frac_correct", "frac_incorrect", "frac_refused"])

    O["non_correct_rate"] = rnd(with_([RESPONSES], """
      SELECT dataset, count(*) AS n, avg(CAST(lower(correctness) <> 'correct' AS DOUBLE)) AS non_correct_rate
      FROM responses_fx GROUP BY dataset"""), ["non_correct_rate"])

    O["describe_lineitem"] = rnd(with_([LI_ROWS, LI_LONG], """
      SELECT dataset, feature, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
             max(value) AS max, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
             quantile_cont(value, 0.75) AS q75
      FROM li_long WHERE value IS NOT NULL GROUP BY dataset, feature"""), ["mean", "std", "min", "max", "q25", "q50", "q75"])

    feats = LINEITEM_FEATURES + ["y"]
    pairs = []
    for i, a in enumerate(feats):
        for b in feats[i:]:
            pairs.append(f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS r FROM li_rows")
            if a != b:
                pairs.append(f"SELECT '{b}', '{a}', corr({a}, {b}) FROM li_rows")
    O["correlation_matrix"] = rnd(with_([LI_ROWS], " UNION ALL ".join(pairs)), ["r"])

    O["spearman_lineitem"] = rnd(with_([LI_ROWS], """
      SELECT dataset, corr(quantity, extendedprice) AS pearson, corr(ra, rb) AS spearman, count(*) AS n FROM (
        SELECT *, (rank() OVER (PARTITION BY dataset ORDER BY quantity) * 2 + count(*) OVER (PARTITION BY dataset, quantity) - 1) / 2.0 AS ra,
                  (rank() OVER (PARTITION BY dataset ORDER BY extendedprice) * 2 + count(*) OVER (PARTITION BY dataset, extendedprice) - 1) / 2.0 AS rb
        FROM li_rows) GROUP BY dataset"""), ["pearson", "spearman"])

    O["group_target"] = rnd(with_([RESPONSES], """
      SELECT prompt_id, CAST(sum(CAST(correctness <> 'correct' AS INTEGER)) AS BIGINT) AS n_wrong, count(*) AS n,
             sum(CAST(correctness <> 'correct' AS INTEGER)) / count(*) AS p_hat,
             CAST(sum(CAST(correctness <> 'correct' AS INTEGER)) >= 8 AS INTEGER) AS y
      FROM responses_fx GROUP BY prompt_id"""), ["p_hat"])

    O["group_size_histogram"] = with_([PARAPHRASE], """
      SELECT group_size, count(*) AS n_groups FROM (SELECT answer, count(*) AS group_size FROM para GROUP BY answer) GROUP BY group_size""")

    O["p_hat_question_domain"] = rnd(with_([RESPONSES], """
      SELECT question, domain, avg(CAST(correctness <> 'correct' AS DOUBLE)) AS p_hat FROM responses_fx GROUP BY question, domain"""), ["p_hat"])

    O["lambda_max_mean"] = rnd(with_([EIGEN], "SELECT id, avg(eig) AS lambda_max_mean FROM eigen WHERE rank = 1 GROUP BY id"), ["lambda_max_mean"])
    O["head_topk_mean"] = rnd(with_([EIGEN], "SELECT id, layer, head, avg(eig) AS mean_eig FROM eigen GROUP BY id, layer, head"), ["mean_eig"])

    O["uniform_group_size"] = with_([RESPONSES], """
      SELECT count(DISTINCT n) = 1 AS uniform, min(n) AS min_n, max(n) AS max_n FROM (SELECT prompt_id, count(*) AS n FROM responses_fx GROUP BY prompt_id)""")

    O["pooled_by_dataset"] = rnd(with_([RESPONSES, COUNTS], """
      , f AS (SELECT c.*, d.dataset FROM qcounts c JOIN (SELECT DISTINCT prompt_id, dataset FROM responses_fx) d ON c.prompt_id = d.prompt_id)
      SELECT dataset, count(*) AS n_questions, avg(label) AS rate FROM f GROUP BY dataset
      UNION ALL SELECT 'Pooled', count(*), avg(label) FROM f"""), ["rate"])

    auc_long = auc_sql("li_long", ["dataset", "feature"], "value", "label", "fa")
    piv = ", ".join(f"max(CASE WHEN feature = '{f}' THEN auc END) AS {f}" for f in LINEITEM_FEATURES)
    O["pivot_auc"] = rnd(with_([LI_ROWS, LI_LONG] + auc_long, f"SELECT dataset, {piv} FROM fa GROUP BY dataset"), LINEITEM_FEATURES)

    O["paraphrase_classes"] = with_([PARAPHRASE], """
      SELECT row_id, class_id, row_number() OVER (PARTITION BY class_id ORDER BY question, row_id) AS question_in_class FROM (
        SELECT *, 'C' || lpad(CAST(dense_rank() OVER (ORDER BY answer) AS VARCHAR), 4, '0') AS class_id FROM para)""")

    O["first_row"] = with_([RESPONSES], "SELECT prompt_id, min(id) AS first_id, arg_min(correctness, id) AS first_correctness FROM responses_fx GROUP BY prompt_id")

    O["best_feature"] = rnd(with_([LI_ROWS, LI_LONG] + auc_long, """
      SELECT dataset, arg_max(feature, (auc, feature)) AS best_feature, max(auc) AS best_auc FROM fa GROUP BY dataset"""), ["best_auc"])

    O["top_questions"] = rnd(with_(QTABLE, """
      SELECT dataset, prompt_id, D_cos, rk FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY dataset ORDER BY D_cos DESC, prompt_id) AS INTEGER) AS rk FROM qtable) WHERE rk <= 3"""), ["D_cos"])

    O["stratified_sample"] = with_([RESPONSES], f"""
      SELECT domain, id, rk FROM (
        SELECT domain, id, CAST(row_number() OVER (PARTITION BY domain ORDER BY {md5i("7", "id")}, id) AS INTEGER) AS rk FROM responses_fx)
      WHERE rk <= 3""")

    O["quota_allocation"] = with_([PARAPHRASE], """
      , c AS (SELECT domain, count(DISTINCT answer) AS n_groups FROM para GROUP BY domain),
      b AS (SELECT *, least(n_groups, CAST(floor(100 / (SELECT count(*) FROM c)) AS BIGINT)) AS base FROM c),
      r AS (SELECT *, 100 - sum(base) OVER () AS remaining, n_groups - base AS spare FROM b),
      s AS (SELECT *, coalesce(sum(spare) OVER (ORDER BY n_groups DESC, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM r)
      SELECT domain, n_groups, CAST(base + least(spare, greatest(0, remaining - prev)) AS BIGINT) AS quota FROM s""")

    O["text_dispersion"] = rnd(with_([RESPONSES] + text_vec() + geometry("g_", "text_vec"), "SELECT * FROM g_geo"), GEO)
    O["dense_dispersion"] = rnd(with_([DENSE_VEC] + geometry("g_", "dense_vec"), "SELECT * FROM g_geo"), GEO)
    O["dense_centroid_builtin"] = rnd(with_([DENSE_VEC] + geometry("g_", "dense_vec"), "SELECT prompt_id, n, D_cos, D_pair FROM g_geo"), ["D_cos", "D_pair"])

    O["laplacian_diagonal"] = rnd(with_([ATTENTION], """
      SELECT c.id, c.layer, c.head, c.j, c.col_sum / greatest(t.T - c.j, 1) - coalesce(c.a_jj, 0.0) AS eig, t.T FROM
        (SELECT id, layer, head, j, sum(a) AS col_sum, max(CASE WHEN i = j THEN a END) AS a_jj FROM attention GROUP BY ALL) c
      JOIN (SELECT id, max(i) + 1 AS T FROM attention GROUP BY id) t ON c.id = t.id"""), ["eig"])

    lap = """lap AS (
      SELECT c.id, c.layer, c.head, c.j, c.col_sum / greatest(t.T - c.j, 1) - coalesce(c.a_jj, 0.0) AS eig FROM
        (SELECT id, layer, head, j, sum(a) AS col_sum, max(CASE WHEN i = j THEN a END) AS a_jj FROM attention GROUP BY ALL) c
      JOIN (SELECT id, max(i) + 1 AS T FROM attention GROUP BY id) t ON c.id = t.id),
    topk AS (SELECT id, layer, head, CAST(row_number() OVER (PARTITION BY id, layer, head ORDER BY eig DESC, j) AS INTEGER) AS rank, eig FROM lap
             QUALIFY rank <= 4)"""
    O["laplacian_topk"] = rnd(with_([ATTENTION, lap], "SELECT * FROM topk"), ["eig"])
    O["attention_score"] = rnd(with_([ATTENTION], """
      SELECT id, layer, head, avg(ln(greatest(a, 1e-10))) AS attention_score FROM attention WHERE i = j GROUP BY ALL"""), ["attention_score"])

    from ..operators.attention import eigen_names
    names = eigen_names(4, 4, 4)
    wide = ", ".join(f"max(CASE WHEN layer = {n.split('_')[1][1:]} AND head = {n.split('_')[2][1:]} AND rank = {n.split('_')[3][1:]} THEN eig END) AS {n}" for n in names)
    O["eigen_wide"] = rnd(with_([EIGEN], f"SELECT id, {wide} FROM eigen GROUP BY id"), names)

    O["attention_training_set"] = rnd(with_([ATTENTION, lap, ATT_LABELS], """
      SELECT v.id, l.dataset, l.label, v.feature_sum, s.mean_attention_score FROM
        (SELECT id, sum(eig) AS feature_sum, count(*) AS n FROM topk GROUP BY id HAVING count(*) = 16) v
      JOIN (SELECT id, avg(sc) AS mean_attention_score FROM (
              SELECT id, layer, head, avg(ln(greatest(a, 1e-10))) AS sc FROM attention WHERE i = j GROUP BY ALL) GROUP BY id) s
        ON v.id = s.id
      JOIN att_labels l ON l.id = v.id"""), ["feature_sum", "mean_attention_score"])

    O["ks_lineitem"] = rnd(with_([LI_ROWS, LI_LONG] + ks_sql("li_long", ["dataset", "feature"], 4), "SELECT * FROM ks_out"),
                           ["ks_stat", "p_value"])

    qlong = "qlong AS (" + " UNION ALL ".join(
        f"SELECT prompt_id, label, '{f}' AS feature, {f} AS value FROM qtable" for f in GEO) + ")"
    O["ks_questions"] = rnd(with_(QTABLE + [qlong] + ks_sql("qlong", ["feature"], 4), "SELECT * FROM ks_out"),
                            ["ks_stat", "p_value"])

    per_head = "ph AS (SELECT id, dataset, label, layer, head, avg(eig) AS value FROM eigen GROUP BY ALL)"
    mwu = f"""mw_c AS (SELECT dataset, layer, head, value, sum(label) AS c1, sum(1 - label) AS c0, count(*) AS c FROM ph GROUP BY ALL),
    mw_r AS (SELECT *, sum(c) OVER (PARTITION BY dataset, layer, head ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - c
                      + (c + 1) / 2.0 AS avg_rank FROM mw_c),
    mw_a AS (SELECT dataset, layer, head, sum(c1 * avg_rank) AS r1, CAST(sum(c1) AS BIGINT) AS n1, CAST(sum(c0) AS BIGINT) AS n0,
                    sum(CAST(c AS DOUBLE) ^ 3 - c) AS tie FROM mw_r GROUP BY ALL),
    mw_b AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u1,
                    sqrt(n1 * n0 / 12.0 * ((n1 + n0 + 1) - tie / ((n1 + n0) * (n1 + n0 - 1.0)))) AS sigma FROM mw_a WHERE n1 > 0 AND n0 > 0),
    mw_z AS (SELECT *, (greatest(u1, n1 * n0 - u1) - n1 * n0 / 2.0 - 0.5) / sigma AS z FROM mw_b),
    mw AS (SELECT dataset, layer, head, n1, n0, u1 AS u_stat, z,
                  CASE WHEN sigma > 0 THEN least(1.0, 2.0 * {normal_sf('z')}) END AS p_value FROM mw_z),
    mw_out AS (SELECT *, p_value < 0.05 AS significant FROM mw)"""
    O["mann_whitney_heads"] = rnd(with_([EIGEN, per_head, mwu], "SELECT * FROM mw_out"), ["u_stat", "z", "p_value"])
    O["significant_heads"] = rnd(with_([EIGEN.replace("eigen AS", "eigen0 AS", 1),
        "eigen AS (SELECT * FROM eigen0 UNION ALL SELECT id, 'OneClass', label, layer, head, rank, eig FROM eigen0 WHERE label = 1)", per_head,
        mwu, "cells AS (SELECT DISTINCT dataset, layer, head FROM ph)"], """
      SELECT dataset, CAST(sum(CAST(coalesce(significant, false) AS INTEGER)) AS BIGINT) AS n_significant,
             CAST(sum(CAST(p_value IS NOT NULL AS INTEGER)) AS BIGINT) AS n_finite, count(*) AS n_cells,
             sum(CAST(coalesce(significant, false) AS INTEGER)) / count(*) AS share_significant
      FROM cells LEFT JOIN mw_out USING (dataset, layer, head) GROUP BY dataset"""), ["share_significant"])

    O["cohens_d_rank"] = rnd(with_([EIGEN], """
      SELECT rank, n1, n0, m1, m0,
             CASE WHEN n1 < 2 OR n0 < 2 THEN NULL WHEN sp = 0 THEN 0.0 ELSE (m1 - m0) / sp END AS cohens_d FROM (
        SELECT *, sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS sp FROM (
          SELECT rank, CAST(sum(CAST(label = 1 AS INTEGER)) AS BIGINT) AS n1, CAST(sum(CAST(label = 0 AS INTEGER)) AS BIGINT) AS n0,
                 avg(CASE WHEN label = 1 THEN eig END) AS m1, avg(CASE WHEN label = 0 THEN eig END) AS m0,
                 var_samp(CASE WHEN label = 1 THEN eig END) AS v1, var_samp(CASE WHEN label = 0 THEN eig END) AS v0
          FROM eigen WHERE eig IS NOT NULL AND isfinite(eig) GROUP BY rank))"""), ["m1", "m0", "cohens_d"])

    O["kde_lineitem"] = rnd(with_([LI_ROWS], """
      , st AS (SELECT dataset, y, count(*) AS n, stddev_samp(discount) AS sd, min(discount) AS lo, max(discount) AS hi,
                      stddev_samp(discount) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h FROM li_rows WHERE discount IS NOT NULL GROUP BY ALL),
      g AS (SELECT st.*, gi, lo + gi * ((hi - lo) / 49) AS g FROM st, (SELECT unnest(range(0, 50)) AS gi) r)
      SELECT g.dataset, g.y, CAST(g.gi AS INTEGER) AS gi, g.g, sum(exp(-pow(r.discount - g.g, 2) / (2 * g.h * g.h))) / (g.n * g.h * sqrt(2 * pi())) AS density
      FROM g JOIN li_rows r ON r.dataset = g.dataset AND r.y = g.y AND r.discount IS NOT NULL
      GROUP BY g.dataset, g.y, g.gi, g.g, g.n, g.h"""), ["g", "density"])

    O["histogram_lineitem"] = rnd(with_([LI_ROWS], """
      , rg AS (SELECT dataset, min(extendedprice) AS lo, max(extendedprice) AS hi FROM li_rows GROUP BY dataset),
      b AS (SELECT r.dataset, r.y, rg.lo, rg.hi, CAST(CASE WHEN rg.hi = rg.lo THEN 0 ELSE least(floor((r.extendedprice - rg.lo) / ((rg.hi - rg.lo) / 40)), 39) END AS INTEGER) AS bin
            FROM li_rows r JOIN rg ON r.dataset = rg.dataset WHERE r.extendedprice IS NOT NULL),
      t AS (SELECT dataset, y, count(*) AS tot FROM b GROUP BY ALL)
      SELECT b.dataset, b.y, b.bin, b.lo + b.bin * ((b.hi - b.lo) / 40) AS bin_left, b.lo + (b.bin + 1) * ((b.hi - b.lo) / 40) AS bin_right,
             count(*) AS n, CASE WHEN (b.hi - b.lo) / 40 > 0 THEN count(*) / (t.tot * ((b.hi - b.lo) / 40)) END AS density
      FROM b JOIN t ON b.dataset = t.dataset AND b.y = t.y GROUP BY b.dataset, b.y, b.bin, b.lo, b.hi, t.tot"""),
        ["bin_left", "bin_right", "density"])

    O["permutation_test"] = rnd(with_(QTABLE + [f"""
      obs AS (SELECT dataset, avg(CASE WHEN label = 1 THEN D_cos END) - avg(CASE WHEN label = 0 THEN D_cos END) AS delta,
                     sum(label) AS n1 FROM qtable WHERE D_cos IS NOT NULL AND label IS NOT NULL GROUP BY dataset),
      reps AS (SELECT q.dataset, q.prompt_id, q.D_cos, r.rep,
                      row_number() OVER (PARTITION BY q.dataset, r.rep ORDER BY {md5i("42", "r.rep", "q.prompt_id")}, q.prompt_id) AS rn
               FROM qtable q, (SELECT unnest(range(1, 10001)) AS rep) r WHERE q.D_cos IS NOT NULL AND q.label IS NOT NULL),
      nul AS (SELECT r.dataset, r.rep, avg(CASE WHEN rn <= o.n1 THEN D_cos END) - avg(CASE WHEN rn > o.n1 THEN D_cos END) AS d
              FROM reps r JOIN obs o ON r.dataset = o.dataset GROUP BY r.dataset, r.rep)"""], """
      SELECT o.dataset, (sum(CAST(n.d >= o.delta - 1e-12 AS INTEGER)) + 1) / 10001.0 AS p_value, avg(n.d) AS null_mean,
             stddev_pop(n.d) AS null_std, o.delta
      FROM nul n JOIN obs o ON n.dataset = o.dataset GROUP BY o.dataset, o.delta"""), ["p_value", "null_mean", "null_std", "delta"])

    def poisson(u: str) -> str:
        total, parts = 0.0, []
        for k in range(12):
            total += math.exp(-1) / math.factorial(k)
            parts.append(f"CAST({u} >= {total!r} AS INTEGER)")
        return "(" + " + ".join(parts) + ")"

    O["bootstrap_mean_diff"] = rnd(with_([EIGEN, f"""
      lm AS (SELECT e.id, avg(eig) AS v, any_value(dataset) AS dataset, any_value(label) AS y FROM eigen e WHERE rank = 1 GROUP BY e.id),
      both_ AS (SELECT * FROM lm UNION ALL SELECT id, v, 'Pooled', y FROM lm UNION ALL SELECT id, v, 'OneClass', y FROM lm WHERE y = 1),
      draws AS (SELECT x.*, r.rep, {md5u("137", "r.rep", "x.id")} AS u FROM both_ x, (SELECT unnest(range(1, 1001)) AS rep) r),
      w AS (SELECT *, {poisson('u')} AS w FROM draws),
      per AS (SELECT dataset, rep, sum(CASE WHEN y = 1 THEN w * v END) / nullif(sum(CASE WHEN y = 1 THEN w END), 0)
                     - sum(CASE WHEN y = 0 THEN w * v END) / nullif(sum(CASE WHEN y = 0 THEN w END), 0) AS delta
              FROM w GROUP BY dataset, rep),
      ok AS (SELECT * FROM per WHERE delta IS NOT NULL),
      obs AS (SELECT dataset, avg(CASE WHEN y = 1 THEN v END) - avg(CASE WHEN y = 0 THEN v END) AS delta_obs,
                     CAST(sum(CAST(y = 1 AS INTEGER)) AS BIGINT) AS n_pos, CAST(sum(CAST(y = 0 AS INTEGER)) AS BIGINT) AS n_neg FROM both_ GROUP BY dataset)"""], """
      SELECT o.dataset, o.delta_obs, o.n_pos, o.n_neg, quantile_cont(k.delta, 0.025) AS ci_low, quantile_cont(k.delta, 0.975) AS ci_high,
             avg(CAST(k.delta <= 0 AS DOUBLE)) AS p_value, count(k.delta) AS n_replicates
      FROM obs o LEFT JOIN ok k ON o.dataset = k.dataset GROUP BY o.dataset, o.delta_obs, o.n_pos, o.n_neg"""), ["delta_obs", "ci_low", "ci_high", "p_value"])

    O["auc_by_dataset"] = rnd(with_([LI_ROWS, PREDS] + auc_sql("preds", ["dataset"], "y_prob", "y_true") + ap_sql("preds", ["dataset"], "y_prob", "y_true"),
                                    "SELECT a.*, ap.average_precision FROM auc a JOIN ap ON a.dataset = ap.dataset"), ["auc", "average_precision"])

    O["roc_points"] = rnd(with_([LI_ROWS, PREDS], """
      , c AS (SELECT dataset, y_prob AS score, sum(y_true) AS c1, sum(1 - y_true) AS c0 FROM preds GROUP BY ALL),
      cc AS (SELECT *, sum(c1) OVER w AS tp, sum(c0) OVER w AS fp, sum(c1) OVER (PARTITION BY dataset) AS n1, sum(c0) OVER (PARTITION BY dataset) AS n0
             FROM c WINDOW w AS (PARTITION BY dataset ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT dataset, score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
             CASE WHEN n1 = 0 THEN 0.0 ELSE tp / n1 END AS tpr, CASE WHEN n0 = 0 THEN 0.0 ELSE fp / n0 END AS fpr,
             CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN n1 = 0 THEN 0.0 ELSE tp / n1 END AS recall
      FROM cc"""), ["threshold", "tpr", "fpr", "precision", "recall"])

    def thr_rows(thresholds):
        parts = []
        for t in thresholds:
            parts.append(f"""SELECT dataset, {t!r} AS threshold,
                CAST(sum(CASE WHEN y_prob >= {t} AND y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
                CAST(sum(CASE WHEN y_prob >= {t} AND y_true = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
                CAST(sum(CASE WHEN y_prob < {t} AND y_true = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
                CAST(sum(CASE WHEN y_prob < {t} AND y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM preds GROUP BY dataset""")
        return " UNION ALL ".join(parts)

    thr_sel = """SELECT dataset, threshold, (tp + tn) / (tp + fp + tn + fn) AS accuracy,
             CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
             CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
             CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
             CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END AS specificity, tp, fp, tn, fn FROM ({rows})"""
    O["threshold_table"] = rnd(with_([LI_ROWS, PREDS], thr_sel.format(rows=thr_rows([0.2, 0.3, 0.5, 0.7, 0.8]))),
                               ["threshold", "accuracy", "precision", "recall", "f1", "specificity"])

    O["classification_metrics"] = rnd(with_([LI_ROWS, PREDS] + auc_sql("preds", ["dataset"], "y_prob", "y_true") + ap_sql("preds", ["dataset"], "y_prob", "y_true") + [
        "br AS (SELECT dataset, avg((y_prob - y_true) * (y_prob - y_true)) AS brier_score FROM preds GROUP BY dataset)",
        "th AS (" + thr_sel.format(rows=thr_rows([0.5])) + ")"], """
      SELECT a.dataset, a.auc AS roc_auc, ap.average_precision, br.brier_score, th.accuracy AS accuracy_at_0_5,
             th.precision AS precision_at_0_5, th.recall AS recall_at_0_5, th.f1 AS f1_at_0_5
      FROM auc a JOIN ap ON a.dataset = ap.dataset JOIN br ON br.dataset = a.dataset JOIN th ON th.dataset = a.dataset"""),
        ["roc_auc", "average_precision", "brier_score", "accuracy_at_0_5", "precision_at_0_5", "recall_at_0_5", "f1_at_0_5"])

    O["calibration_bins"] = rnd(with_([LI_ROWS, PREDS], """
      SELECT dataset, CAST(greatest(ceil(y_prob * 10 / (1.0 + 1e-8)) - 1, 0) AS INTEGER) AS bin,
             avg(y_prob) AS prob_pred, avg(CAST(y_true AS DOUBLE)) AS prob_true, count(*) AS n
      FROM preds GROUP BY ALL"""), ["prob_pred", "prob_true"])

    flong = "flong AS (" + " UNION ALL ".join(
        f"SELECT prompt_id, label, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM qtable" for f in GEO + ["score_mean", "len_mean"]) + ")"
    O["feature_auc"] = rnd(with_(QTABLE + [flong] + auc_sql("flong", ["feature"], "value", "label", "fauc"), "SELECT * FROM fauc"), ["auc"])

    zs = ", ".join(f"CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END AS {c}_z"
                   for c in LINEITEM_FEATURES)
    O["standardize_lineitem"] = rnd(with_([LI_ROWS], f"SELECT row_id, {zs} FROM li_rows"), [c + "_z" for c in LINEITEM_FEATURES])
    order = f"{md5i('42', 'row_id')}, row_id"
    O["stratified_split"] = with_([LI_ROWS], f"""
      SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY {order}) <= round(count(*) OVER (PARTITION BY y) * 0.2) AS is_test
      FROM li_rows""")
    O["stratified_folds"] = with_([LI_ROWS], f"""
      SELECT row_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {order}) - 1) % 5 AS INTEGER) AS fold FROM li_rows""")
    O["daily_error_rate"] = rnd("""
      SELECT time_bucket(INTERVAL 1 day, ts) AS window_start, CAST(user_id % 4 AS INTEGER) AS user_bucket, count(*) AS n,
             CAST(sum(CAST(event_type = 'error' AS INTEGER)) AS BIGINT) AS n_flagged,
             sum(CAST(event_type = 'error' AS INTEGER)) / count(*) AS rate
      FROM events GROUP BY ALL""", ["rate"])
    O["dedup_events"] = "SELECT event_id, min(ts) AS ts, arg_min(event_type, ts) AS event_type FROM events GROUP BY event_id"
    signed = ", ".join(f"""sum(CASE WHEN {md5i("42", str(j), "pos")} % 2 = 1 THEN v ELSE -v END) / 8.0 AS z{j}""" for j in (1, 2))
    points = f"pts AS (SELECT prompt_id, id, {signed} FROM dense_vec GROUP BY prompt_id, id)"
    O["domain_median_centroid"] = rnd(with_([DENSE_VEC, points], """
      SELECT prompt_id, median(z1) AS median_z1, median(z2) AS median_z2, count(*) AS n FROM pts GROUP BY prompt_id HAVING count(*) >= 5"""), ["median_z1", "median_z2"])
    # a pair of points is an edge of the hull if no point lies to its right; collinear points on an edge are no corners
    O["hull_area_2d"] = rnd(with_([DENSE_VEC, points, """
      d AS (SELECT DISTINCT prompt_id, z1 AS x, z2 AS y FROM pts),
      e AS (SELECT a.prompt_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM d a JOIN d b ON a.prompt_id = b.prompt_id AND (a.x <> b.x OR a.y <> b.y)
            WHERE NOT EXISTS (SELECT 1 FROM d c WHERE c.prompt_id = a.prompt_id AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < -1e-12))"""], """
      SELECT p.prompt_id, coalesce(CASE WHEN n < 3 THEN 0.0 ELSE s END, 0.0) AS hull_area, CAST(coalesce(v, n) AS INTEGER) AS n_vertices
      FROM (SELECT prompt_id, count(*) AS n FROM d GROUP BY prompt_id) p
      LEFT JOIN (SELECT prompt_id, sum(ax * b_y - bx * ay) / 2 AS s, count(*) AS v FROM e GROUP BY prompt_id) h USING (prompt_id)"""), ["hull_area"])
    O["density_peak_2d"] = rnd(with_([DENSE_VEC, points, """
      b AS (SELECT prompt_id, min(z1) AS x0, max(z1) AS x1, min(z2) AS y0, max(z2) AS y1 FROM pts GROUP BY prompt_id),
      g AS (SELECT b.prompt_id, gi AS g, x0 + (gi % 20) * (x1 - x0) / 19 AS gx, y0 + floor(gi / 20) * (y1 - y0) / 19 AS gy
            FROM b, (SELECT unnest(range(0, 400)) AS gi) r),
      d AS (SELECT g.prompt_id, g.g, g.gx, g.gy, sum(exp(-(pow(p.z1 - g.gx, 2) + pow(p.z2 - g.gy, 2)) / (2 * 0.25 * 0.25))) AS d
            FROM g JOIN pts p ON p.prompt_id = g.prompt_id GROUP BY ALL)"""], """
      SELECT prompt_id, arg_max(gx, (d, -g)) AS peak_x, arg_max(gy, (d, -g)) AS peak_y, max(d) AS peak_density
      FROM d GROUP BY prompt_id"""), ["peak_x", "peak_y", "peak_density"])
    O["describe_questions"] = rnd(with_(QTABLE + ["ql AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM qtable" for f in GEO) + ")"], """
      SELECT feature, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
             max(value) AS max, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
             quantile_cont(value, 0.75) AS q75
      FROM ql WHERE value IS NOT NULL GROUP BY feature"""), ["mean", "std", "min", "max", "q25", "q50", "q75"])
    O["graph_spectrum_moments"] = rnd(with_([DENSE_VEC], """
      , w AS (SELECT a.prompt_id, a.id AS i, b.id AS j, greatest(sum(a.v * b.v), 0) AS w FROM dense_vec a JOIN dense_vec b
              ON a.prompt_id = b.prompt_id AND a.pos = b.pos AND a.id <> b.id GROUP BY ALL),
      d AS (SELECT prompt_id, i, sum(w) AS d, sum(w * w) AS s FROM w GROUP BY ALL)
      SELECT prompt_id, sum(d) AS lam_sum, sum(d * d) + sum(s) AS lam_sq_sum FROM d GROUP BY prompt_id"""), ["lam_sum", "lam_sq_sum"])
    O["head_average"] = rnd(with_([EIGEN], "SELECT id, layer, rank, avg(eig) AS mean_eig FROM eigen GROUP BY ALL"), ["mean_eig"])
    O["family_means_by_rank_and_layer"] = rnd(with_([EIGEN], """
      SELECT id, 'rank' AS family, rank AS place, avg(eig) AS mean_eig FROM eigen GROUP BY ALL
      UNION ALL SELECT id, 'layer', layer, avg(eig) FROM eigen GROUP BY ALL"""), ["mean_eig"])
    O["eigen_long_again"] = rnd(with_([EIGEN], "SELECT id, layer, head, rank, eig FROM eigen"), ["eig"])
    O["flipped_permutation"] = O["permutation_test"].replace("D_cos END", "neg END").replace("q.D_cos, r.rep", "q.neg, r.rep").replace(
        "WHERE q.D_cos IS NOT NULL", "WHERE q.neg IS NOT NULL").replace("FROM qtable WHERE D_cos IS NOT NULL", "FROM qneg WHERE neg IS NOT NULL").replace(
        "FROM qtable q,", "FROM qneg q,").replace("obs AS (SELECT dataset", "qneg AS (SELECT *, -D_pair AS neg FROM qtable),\n      obs AS (SELECT dataset", 1)
    O["residual_domain"] = with_([RESPONSES], """
      SELECT r.id, coalesce(m.d, 'Law, Business, and Miscellaneous') AS domain_clean FROM responses_fx r LEFT JOIN (
        SELECT question, domain AS d FROM (
          SELECT question, domain, row_number() OVER (PARTITION BY question ORDER BY cnt DESC, domain) AS rk
          FROM (SELECT question, domain, count(*) AS cnt FROM responses_fx WHERE doc_id % 3 = 0 GROUP BY ALL)) WHERE rk = 1) m
      ON r.question = m.question""")
    O["crosstab_type_correctness"] = O["crosstab_domain_correctness"].replace("SELECT domain, ", "SELECT type, ").replace("GROUP BY domain", "GROUP BY type")
    O["dataset_feature_means"] = rnd(with_(QTABLE, "SELECT dataset, count(*) AS n, " + ", ".join(
        f"avg({c}) AS {c}" for c in ["label", *GEO, "score_mean", "len_mean"]) + " FROM qtable GROUP BY dataset"), ["label", *GEO, "score_mean", "len_mean"])
    O["dispersion_scatter"] = rnd(with_(QTABLE, """
      SELECT prompt_id, D_cos, D_pair, CASE WHEN label = 0 THEN 'Correct' ELSE 'Hallucinated (incl. refused)' END AS "group" FROM qtable"""), ["D_cos", "D_pair"])
    O["pairplot_sample"] = rnd(with_(QTABLE, f"""
      SELECT prompt_id, label, {', '.join(GEO)} FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {md5i("42", "prompt_id")}, prompt_id) AS rk FROM qtable)
      WHERE rk <= 20"""), GEO)
    O["domain_counts"] = rnd(with_(QTABLE, """
      SELECT domain, count(*) AS n_questions, CAST(sum(label) AS BIGINT) AS n_hallucinated, avg(label) AS rate FROM qtable GROUP BY domain"""), ["rate"])
    O["preservation_ratio"] = rnd(with_([LI_ROWS, PREDS, f"""noisy AS (SELECT dataset, y_true, round((y_prob + {md5u("'noise'", "row_id")}) / 2, 3) AS y_prob FROM preds)"""]
        + auc_sql("noisy", ["dataset"], "y_prob", "y_true", "na") + auc_sql("preds", ["dataset"], "y_prob", "y_true", "pa"), """
      SELECT na.dataset, na.auc AS auc_transfer, pa.auc AS auc_in_domain, na.auc / pa.auc AS preservation FROM na JOIN pa ON na.dataset = pa.dataset"""),
        ["auc_transfer", "auc_in_domain", "preservation"])
    six = GEO + ["score_mean", "len_mean"]
    q6 = "qlong6 AS (" + " UNION ALL ".join(f"SELECT prompt_id, label, '{f}' AS feature, {i} AS ord, CAST({f} AS DOUBLE) AS value FROM qtable" for i, f in enumerate(six)) + ")"
    O["ordered_feature_union"] = with_(QTABLE + [q6] + ks_sql("qlong6", ["feature"], 6), """
      , places AS (SELECT DISTINCT feature, ord FROM qlong6),
      c AS (SELECT feature, any_value(ord) AS ord, abs(corr(value, label)) AS r FROM qlong6 GROUP BY feature),
      b AS (SELECT feature, 0 AS part, row_number() OVER (ORDER BY r DESC, ord) AS k FROM c QUALIFY k <= 4),
      u AS (SELECT * FROM b UNION ALL SELECT k.feature, 1, p.ord FROM ks_out k JOIN places p USING (feature) WHERE k.significant AND k.feature NOT IN (SELECT feature FROM b))
      SELECT string_agg(feature, ',' ORDER BY part, k) AS features FROM u""")
    O["roc_band"] = rnd(with_(QTABLE + [f"""
      dr AS (SELECT q.prompt_id, q.D_cos AS s, q.label AS y, r.rep, {md5u("137", "r.rep", "q.prompt_id")} AS u FROM qtable q, (SELECT unnest(range(1, 201)) AS rep) r),
      dw AS (SELECT rep, s, sum({poisson('u')} * y) AS c1, sum({poisson('u')} * (1 - y)) AS c0 FROM dr GROUP BY ALL),
      cv AS (SELECT rep, sum(c1) OVER w AS tp, sum(c0) OVER w AS fp, sum(c1) OVER (PARTITION BY rep) AS n1, sum(c0) OVER (PARTITION BY rep) AS n0
             FROM dw WINDOW w AS (PARTITION BY rep ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      ok2 AS (SELECT * FROM cv WHERE n1 > 0 AND n0 > 0),
      gr AS (SELECT rep, g FROM (SELECT DISTINCT rep FROM ok2), (SELECT unnest(range(0, 200)) AS g)),
      tp AS (SELECT gr.rep, gr.g, CASE WHEN gr.g = 0 THEN 0.0 WHEN gr.g = 199 THEN 1.0
                    ELSE coalesce(max(CASE WHEN ceil(ok2.fp / ok2.n0 * 199 - 1e-9) <= gr.g THEN ok2.tp / ok2.n1 END), 0.0) END AS tpr
             FROM gr JOIN ok2 ON gr.rep = ok2.rep GROUP BY gr.rep, gr.g)"""],
        "SELECT g / 199.0 AS fpr, quantile_cont(tpr, 0.025) AS tpr_low, quantile_cont(tpr, 0.975) AS tpr_high FROM tp GROUP BY g"), ["fpr", "tpr_low", "tpr_high"])
    O["results_summary"] = rnd(with_(QTABLE, f"""
      , pt AS ({O['permutation_test']}),
      raw AS (SELECT dataset, count(DISTINCT prompt_id) AS n_questions, count(*) AS n_responses,
                     {', '.join(f"CAST(sum(CAST(lower(correctness) = '{c}' AS INTEGER)) AS BIGINT) AS n_{c}" for c in LABEL_ORDER)},
                     {', '.join(f"round(avg(CAST(lower(correctness) = '{c}' AS DOUBLE)) * 100, 1) AS pct_{c}" for c in LABEL_ORDER)}
              FROM responses_fx GROUP BY dataset),
      dn AS (SELECT dataset, count(*) AS n_analysed, CAST(sum(CAST(label = 0 AS INTEGER)) AS BIGINT) AS n_label_correct,
                    CAST(sum(CAST(label = 1 AS INTEGER)) AS BIGINT) AS n_label_hallucinated, round(avg(label) * 100, 1) AS pct_hallucinated FROM qtable GROUP BY dataset),
      dm AS (SELECT dataset, CAST(sum(CAST(n >= 15 AS INTEGER)) AS BIGINT) AS n_domains_analysed, CAST(sum(CAST(n < 15 AS INTEGER)) AS BIGINT) AS n_domains_excluded
             FROM (SELECT dataset, domain, count(*) AS n FROM qtable GROUP BY ALL) GROUP BY dataset)
      SELECT raw.*, dn.* EXCLUDE (dataset), dm.* EXCLUDE (dataset), pt.delta, pt.p_value, raw.n_questions - coalesce(dn.n_analysed, 0) AS n_skipped
      FROM raw LEFT JOIN dn USING (dataset) LEFT JOIN dm USING (dataset) LEFT JOIN pt USING (dataset)"""),
        [*[f"pct_{c}" for c in LABEL_ORDER], "pct_hallucinated", "delta", "p_value"])
    q = "p_name || ' #' || CAST(p_partkey AS VARCHAR)"
    none = "CAST(NULL AS VARCHAR[])"
    O["benchmark_questions"] = f"""
      WITH a AS (
        SELECT text AS question, {none} AS choices, CAST(item_id AS VARCHAR) AS reference_answer, 'gsm8k' AS dataset, 'math' AS topic_label, '' AS type FROM benchmark
        UNION ALL SELECT {q}, {none}, '["' || p_brand || '","' || p_type || '"]', 'nq_open', '', '' FROM part
        UNION ALL SELECT {q}, {none}, p_brand, 'truthfulqa', CASE WHEN p_size > 5 THEN p_type ELSE '' END, '' FROM part
        UNION ALL SELECT {q}, {none}, p_brand, 'triviaqa', '', '' FROM part
        UNION ALL SELECT {q}, {none}, p_brand, 'defan', CASE WHEN p_size > 9 THEN p_type ELSE '' END, p_type FROM part
        UNION ALL SELECT {q}, [p_brand, p_type, p_name, 'none'], ['A', 'B', 'C', 'D'][p_size % 4 + 1], 'mmlu', p_type, '' FROM part
        UNION ALL SELECT {q}, {none}, CAST(p_size AS VARCHAR), 'math', p_type, '' FROM part
        UNION ALL SELECT 'Context: ' || p_type || chr(10) || chr(10) || 'Question: ' || {q}, {none}, p_brand, 'halueval', '', '' FROM part)
      SELECT * EXCLUDE (rk) REPLACE (array_to_string(choices, '|') AS choices) FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {md5i("42", "question")}, question) AS rk FROM a) WHERE rk <= 20"""
    O["label_policies"] = rnd(with_([RESPONSES, COUNTS], """
      SELECT r.prompt_id, r.non_correct_rate, r.label_k_of_n, c.label AS label_merged FROM
        (SELECT prompt_id, avg(CAST(lower(correctness) <> 'correct' AS DOUBLE)) AS non_correct_rate,
                CAST(sum(CAST(lower(correctness) <> 'correct' AS INTEGER)) >= 8 AS INTEGER) AS label_k_of_n
         FROM responses_fx GROUP BY prompt_id) r
      LEFT JOIN qcounts c ON c.prompt_id = r.prompt_id"""), ["non_correct_rate"])
    O["embedding_3d_whitened"] = """
      SELECT CAST(a AS INTEGER) AS axis, (SELECT count(*) FROM embeddings) AS n, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS variance FROM range(0, 3) t(a)"""
    O["imputed_median"] = rnd(with_([LI_ROWS], """
      SELECT row_id, coalesce(CASE WHEN quantity > 25 THEN tax END, (SELECT median(tax) FROM li_rows WHERE quantity > 25)) AS tax FROM li_rows"""), ["tax"])
    O["mean_roc_folds"] = rnd(with_([LI_ROWS, PREDS, f"""
      sc AS (SELECT dataset, CAST({md5i("'fold'", "row_id")} % 5 AS INTEGER) AS fold, y_prob AS s, sum(y_true) AS c1, sum(1 - y_true) AS c0 FROM preds GROUP BY ALL),
      cv AS (SELECT dataset, fold, sum(c1) OVER w AS tp, sum(c0) OVER w AS fp, sum(c1) OVER (PARTITION BY dataset, fold) AS n1,
                    sum(c0) OVER (PARTITION BY dataset, fold) AS n0 FROM sc WINDOW w AS (PARTITION BY dataset, fold ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
      pt AS (SELECT dataset, fold, fp / n0 AS x, tp / n1 AS y FROM cv WHERE n1 > 0 AND n0 > 0 UNION ALL SELECT DISTINCT dataset, fold, 0.0, 0.0 FROM cv WHERE n1 > 0 AND n0 > 0),
      li AS (SELECT dataset, fold, g, g / 99.0::DOUBLE AS f, max({{'x': x, 'y': y}}) FILTER (x <= g / 99.0::DOUBLE) AS lo, min({{'x': x, 'y': y}}) FILTER (x > g / 99.0::DOUBLE) AS hi
             FROM pt, (SELECT unnest(range(0, 100)) AS g) GROUP BY ALL)"""], """
      SELECT dataset, CAST(g AS INTEGER) AS g, f AS fpr, avg(CASE WHEN hi IS NULL OR f = lo.x THEN lo.y ELSE lo.y + (f - lo.x) * (hi.y - lo.y) / (hi.x - lo.x) END) AS mean_tpr,
             count(*) AS n_folds FROM li GROUP BY ALL"""), ["fpr", "mean_tpr"])
    qld = "qld AS (" + " UNION ALL ".join(f"SELECT dataset, prompt_id, label, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM qtable WHERE {f} IS NOT NULL" for f in GEO) + ")"
    O["stats_summary"] = rnd(with_(QTABLE + [qld] + ks_sql("qld", ["dataset", "feature"], 4), f"""
      , pt AS ({O['permutation_test']}), kq AS (SELECT * FROM ks_out),
      kd AS (SELECT dataset, CAST(sum(CAST(significant AS INTEGER)) AS BIGINT) AS n_significant, arg_max(feature, (ks_stat, feature)) AS best_ks_feature, max(ks_stat) AS best_ks_stat
             FROM kq GROUP BY dataset),
      ba AS (SELECT dataset, count(*) AS n_questions, avg(label) AS rate FROM qtable GROUP BY dataset),
      dr AS (SELECT q.dataset, q.D_cos AS s, q.label AS y, r.rep, {md5u("42", "r.rep", "q.prompt_id")} AS u FROM qtable q, (SELECT unnest(range(1, 2001)) AS rep) r),
      dw AS (SELECT dataset, rep, s, sum({poisson('u')} * y) AS c1, sum({poisson('u')} * (1 - y)) AS c0 FROM dr GROUP BY ALL),
      cv AS (SELECT dataset, rep, c1, c0, sum(c0) OVER (PARTITION BY dataset, rep ORDER BY s ROWS UNBOUNDED PRECEDING) AS cum0,
                    sum(c1) OVER (PARTITION BY dataset, rep) AS n1, sum(c0) OVER (PARTITION BY dataset, rep) AS n0 FROM dw),
      au AS (SELECT dataset, rep, sum(c1 * (cum0 - 0.5 * c0)) / any_value(n1 * n0) AS auc FROM cv WHERE n1 > 0 AND n0 > 0 GROUP BY dataset, rep),
      bo AS (SELECT dataset, avg(auc) AS auc_mean, quantile_cont(auc, 0.025) AS auc_low, quantile_cont(auc, 0.975) AS auc_high FROM au GROUP BY dataset)
      SELECT ba.*, kd.* EXCLUDE (dataset), pt.delta, pt.p_value, bo.* EXCLUDE (dataset)
      FROM ba LEFT JOIN kd USING (dataset) LEFT JOIN pt USING (dataset) LEFT JOIN bo USING (dataset)"""),
        ["rate", "best_ks_stat", "delta", "p_value", "auc_mean", "auc_low", "auc_high"])
    return O
