"""SQL counterparts of the registered queries, for DuckDB over the same tables.

``CTES`` holds named building blocks; ``compose`` puts the ones a statement
uses, directly or not, in front of it.
"""

from __future__ import annotations

import re

from pairforge import constants as K


def strip(x: str) -> str:
    cls = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
    return f"regexp_replace({x}, '^{cls}+|{cls}+$', '', 'g')"


def is_text(x: str) -> str:
    return f"coalesce({strip(x)} <> '', false)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def prefix_case(prompts: dict[str, str], name: str) -> str:
    whens = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in prompts.items())
    return f"CASE {name} {whens} ELSE '' END"


def effective_prompt(role: str, name: str) -> str:
    return (
        f"CASE WHEN {name} IN ('None', 'nan') THEN NULL "
        f"WHEN {role} IN ('positive', 'negative', 'document', 'sentence_b') "
        f"AND {name} IN ('sts', 'ret', 'bitext') THEN 'document' ELSE {name} END"
    )


def spelled(x: str) -> str:
    return f"coalesce(length(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


def spelled_list(x: str) -> str:
    return f"coalesce('[' || array_to_string(list_transform({x}, lambda t: {spelled('t')}), '') || ']', '-')"


SPELLED = " || ".join([spelled("row_ord"), spelled("task"), spelled_list("texts"), spelled_list("roles"), spelled_list("ids")])
USE_QUERY = (
    "(role = 'query' OR (task = 'sts' AND role = 'sentence_a') OR (task = 'bitext' AND side = 0))"
)
EMPTY = "CAST([] AS VARCHAR[])"
N_VECTORS = "(SELECT count(*) FROM embeddings)"

CTES: dict[str, str] = {
    # --- source-shaped tables
    "fx_sts": """
        SELECT d1.doc_id AS row_ord, d1.lang, d1.text AS sentence1, d2.text AS sentence2,
               CAST(5 * l.quality - 2 * l.toxic AS DOUBLE) AS score
        FROM documents d1 JOIN documents d2 ON d2.doc_id = d1.doc_id + 1
        LEFT JOIN labels l ON l.doc_id = d1.doc_id""",
    "fx_turns": """
        SELECT a.conv_id, a.turn // 16 AS part, row_number() OVER (ORDER BY a.conv_id, a.turn) - 1 AS row_ord, a.text AS query, b.text AS answer
        FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
        WHERE a.role = 'user' AND b.role = 'assistant'""",
    "fx_replies": """
        SELECT conv_id - 1 AS conv_id, turn // 16 AS part, list(text ORDER BY turn) AS replies
        FROM conversations WHERE role = 'assistant' GROUP BY 1, 2""",
    "fx_triples": f"""
        SELECT t.conv_id, row_ord, query, answer AS positive,
               list_concat(CASE WHEN t.conv_id % 3 = 0 THEN [''] ELSE {EMPTY} END,
                           coalesce(replies, {EMPTY})) AS negative
        FROM fx_turns t LEFT JOIN fx_replies r ON r.conv_id = t.conv_id AND r.part = t.part""",
    "fx_bitext": """
        SELECT e.k AS row_ord, e.text AS en, f.text AS fr
        FROM (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents WHERE lang = 'en') e
        JOIN (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents WHERE lang = 'fr') f
          ON e.k = f.k""",
    # --- normalised examples
    "ex_sts": f"""
        SELECT 0 AS source_seq, row_ord, 'sts-' || lang || '-docs-' || row_ord AS example_id, 'sts' AS task, lang,
               [{strip('sentence1')}, {strip('sentence2')}] AS texts,
               ['sentence_a', 'sentence_b'] AS roles, ['sts_query', 'document'] AS tp,
               ['sts', 'document'] AS sp, score AS label
        FROM fx_sts WHERE {is_text('sentence1')} AND {is_text('sentence2')}""",
    "ex_triples": f"""
        SELECT 1 AS source_seq, row_ord, 'ret-en-msmarco-' || row_ord AS example_id, 'retrieval' AS task,
               'en' AS lang, list_concat([{strip('query')}, positive], neg) AS texts,
               list_concat(['query', 'positive'], list_transform(neg, lambda x: 'negative')) AS roles,
               list_concat(['web_search_query', 'document'], list_transform(neg, lambda x: 'document')) AS tp,
               list_concat(['ret', 'document'], list_transform(neg, lambda x: 'document')) AS sp,
               CAST(NULL AS DOUBLE) AS label
        FROM (SELECT *, list_filter(negative[1:3], lambda x: {is_text('x')}) AS neg FROM fx_triples)
        WHERE {is_text('query')} AND {is_text('positive')}""",
    "ex_passages": f"""
        SELECT 1 AS source_seq, row_ord, 'ret-en-miracl-' || row_ord AS example_id, 'retrieval' AS task,
               'en' AS lang, list_concat([{strip('query')}, {strip('positive')}], neg) AS texts,
               list_concat(['query', 'positive'], list_transform(neg, lambda x: 'negative')) AS roles,
               list_concat(['web_search_query', 'document'], list_transform(neg, lambda x: 'document')) AS tp,
               list_concat(['ret', 'document'], list_transform(neg, lambda x: 'document')) AS sp,
               CAST(NULL AS DOUBLE) AS label
        FROM (SELECT *, list_transform(list_filter(negative, lambda x: {is_text('x')})[1:3],
                                       lambda x: {strip('x')}) AS neg FROM fx_triples)
        WHERE {is_text('query')} AND {is_text('positive')}""",
    "ex_answers": f"""
        SELECT 1 AS source_seq, row_ord, 'ret-en-mrtydi-' || row_ord AS example_id, 'retrieval' AS task,
               'en' AS lang, [{strip('query')}, {strip('answer')}] AS texts, ['query', 'positive'] AS roles,
               ['web_search_query', 'document'] AS tp, ['ret', 'document'] AS sp, CAST(NULL AS DOUBLE) AS label
        FROM fx_turns WHERE conv_id % 5 <> 0 AND {is_text('query')} AND {is_text('answer')}""",
    "ex_bitext": f"""
        SELECT 2 AS source_seq, row_ord, 'bitext-en-fr-' || row_ord AS example_id, 'bitext' AS task,
               'en-fr' AS lang, [{strip('en')}, {strip('fr')}] AS texts, ['sentence_a', 'sentence_b'] AS roles,
               ['bitext_query', 'bitext_query'] AS tp, ['bitext', 'bitext'] AS sp, CAST(NULL AS DOUBLE) AS label
        FROM fx_bitext WHERE {is_text('en')} AND {is_text('fr')}""",
    "ex_all": "SELECT * FROM ex_sts UNION ALL SELECT * FROM ex_triples UNION ALL SELECT * FROM ex_bitext",
    "ex": """
        SELECT *, list_transform(texts, lambda t: base || '_' || left(sha1(base || '||' || t), 16)) AS ids
        FROM (SELECT *, split_part(lang, '-', 1) AS base FROM ex_all)""",
    "sides": """
        SELECT source_seq, row_ord, example_id, task, lang, base, label, s - 1 AS side, texts[s] AS text,
               roles[s] AS role, tp[s] AS tp, sp[s] AS sp, ids[s] AS text_id
        FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS s FROM ex)""",
    "bad": """
        SELECT source_seq, row_ord, example_id, label,
               CASE WHEN k = 0 THEN 'invalid_task' WHEN k = 1 THEN 'empty_texts' WHEN k = 2 THEN 'unequal_lengths'
                    WHEN k = 3 THEN 'invalid_role' WHEN k = 4 THEN 'blank_text' END AS error
        FROM (SELECT *, row_ord % 10 AS k FROM ex_all)""",
    # --- texts, splits
    "texts": """
        SELECT text_id, text, base AS lang, source_seq, row_ord, side, n_uses
        FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY source_seq, row_ord, side) AS rn,
                     count(*) OVER (PARTITION BY text_id) AS n_uses FROM sides)
        WHERE rn = 1""",
    "capped_texts": "SELECT * FROM texts ORDER BY source_seq, row_ord, side LIMIT 300",
    "placed": """
        SELECT *, CASE WHEN n >= 100 THEN greatest(1, n // 100) ELSE 0 END AS n_val
        FROM (SELECT *, row_number() OVER (ORDER BY source_seq, row_ord) - 1 AS p, count(*) OVER () AS n FROM ex)""",
    "split_ex": """
        SELECT *, CASE WHEN p < n_val THEN 'val' ELSE 'train' END AS split,
               CASE WHEN p < n_val THEN p ELSE p - n_val END AS pos FROM placed""",
    "shards": "SELECT *, pos // 50 AS shard FROM split_ex",
    "prompted": f"""
        SELECT text_id, tp AS prompt_name, {prefix_case(K.TEACHER_PROMPTS, 'tp')} || text AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY source_seq DESC, row_ord DESC, side DESC) AS rn
              FROM sides WHERE tp IS NOT NULL AND tp NOT IN ('document', 'None', 'nan')
                AND role IN ('query', 'sentence_a', 'sentence_b'))
        WHERE rn = 1""",
    # --- vectors
    "numbered": "SELECT text_id, row_number() OVER (ORDER BY text_id) - 1 AS n FROM texts",
    "doc_vec": f"""
        SELECT text_id, vec_id, embedding AS vec
        FROM (SELECT text_id, n % {N_VECTORS} AS vec_id FROM numbered) JOIN embeddings USING (vec_id) WHERE label <> 9""",
    "query_vec": f"""
        SELECT d.text_id, e.embedding AS vec FROM doc_vec d JOIN prompted USING (text_id)
        JOIN embeddings e ON e.vec_id = (d.vec_id * 7 + 3) % {N_VECTORS}""",
    "both_vec": """
        SELECT d.text_id, d.vec AS doc, coalesce(q.vec, d.vec) AS query
        FROM doc_vec d LEFT JOIN query_vec q USING (text_id)""",
    "tokens": """
        SELECT label AS id, embedding AS vec, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos
        FROM embeddings""",
    "kept_tokens": "SELECT * FROM tokens WHERE pos % 5 <> 0",
    # --- batches
    "dealt": """
        SELECT *, p % 2 AS rank, (p // 2) // 8 AS step, (p // 2) % 8 AS slot
        FROM (SELECT *, row_number() OVER (ORDER BY sha1('7:1:' || source_seq || ':' || row_ord)) - 1 AS p FROM ex)""",
    "full_batches": """
        SELECT * FROM dealt WHERE step < ((SELECT count(*) FROM ex) // 2) // 8""",
    "lacking": """
        SELECT DISTINCT source_seq, row_ord FROM sides WHERE text_id NOT IN (SELECT text_id FROM doc_vec)""",
    "batch_sides": """
        SELECT b.step, b.rank, s.*, row_number() OVER (PARTITION BY b.step, b.rank ORDER BY b.slot, s.side) - 1 AS local_idx
        FROM full_batches b JOIN sides s USING (source_seq, row_ord)
        WHERE NOT EXISTS (SELECT 1 FROM lacking l WHERE l.source_seq = b.source_seq AND l.row_ord = b.row_ord)""",
    "batch_rows": f"""
        SELECT *, count(*) OVER (PARTITION BY source_seq, row_ord) AS kept,
               count(*) FILTER (WHERE role = 'sentence_a') OVER (PARTITION BY source_seq, row_ord) AS n_a,
               count(*) FILTER (WHERE role = 'sentence_b') OVER (PARTITION BY source_seq, row_ord) AS n_b,
               {USE_QUERY} AS use_query,
               {prefix_case(K.STUDENT_PROMPTS, effective_prompt('role', 'sp'))} || text AS student_text
        FROM batch_sides WHERE local_idx < 24""",
    "inner_pairs": """
        SELECT a.step, a.rank, a.task, a.label, a.role AS ra, b.role AS rb, a.side AS sa, b.side AS sb,
               a.n_a, a.n_b, a.local_idx AS i, b.local_idx AS j
        FROM batch_rows a JOIN batch_rows b USING (step, rank, source_seq, row_ord)
        WHERE a.kept >= 2 AND a.local_idx <> b.local_idx""",
    "one_way": """
        SELECT step, rank, i, j FROM inner_pairs
        WHERE (ra = 'query' AND rb = 'positive')
           OR (ra = 'sentence_a' AND rb = 'sentence_b' AND (label IS NULL OR label >= 2.5))
           OR (task = 'bitext' AND sa = 0 AND sb = 1)
           OR (task = 'sts' AND n_a = 0 AND sa = 0 AND sb = 1 AND (label IS NULL OR label >= 2.5))""",
    "positives": """
        SELECT step, rank, i, j FROM one_way UNION SELECT step, rank, j AS i, i AS j FROM one_way""",
    "graded": """
        SELECT step, rank, i, j FROM inner_pairs WHERE ra = 'sentence_a' AND rb = 'sentence_b'
        UNION ALL
        SELECT step, rank, i, j FROM inner_pairs
        WHERE task = 'bitext' AND sa = 0 AND sb = 1 AND (n_a = 0 OR n_b = 0)
        UNION ALL
        SELECT step, rank, i, j FROM inner_pairs WHERE task = 'sts' AND sa = 0 AND sb = 1 AND n_a = 0""",
    # --- losses
    "points": """
        SELECT step, rank, rank * 24 + local_idx AS g,
               CAST(CASE WHEN use_query THEN v.query ELSE v.doc END AS DOUBLE[]) AS t,
               CAST(v.doc[1:32] AS DOUBLE[]) AS s
        FROM batch_rows JOIN both_vec v USING (text_id)""",
    "cosines": """
        SELECT a.step, a.rank, a.g AS i, b.g AS j, list_cosine_similarity(a.s, b.s) AS cs,
               list_cosine_similarity(a.t, b.t) AS ct
        FROM points a JOIN points b ON a.step = b.step AND a.g <> b.g""",
    "pos_g": "SELECT step, rank * 24 + i AS i, rank * 24 + j AS j FROM positives",
    "valid_n": "SELECT step, count(*) AS n_valid FROM points GROUP BY step",
    "kl_rows": """
        SELECT step, i, sum(exp(ct / 0.07) * (ct - cs) / 0.07) / sum(exp(ct / 0.07))
                        - ln(sum(exp(ct / 0.07))) + ln(sum(exp(cs / 0.07))) AS kl
        FROM cosines GROUP BY step, i""",
    "loss_kl": "SELECT step, avg(kl) AS v FROM kl_rows GROUP BY step",
    "loss_disp": "SELECT step, ln(avg(exp(2.0 * cs)) + 1e-8) AS v FROM cosines GROUP BY step",
    "weights": """
        SELECT c.step, c.i, c.cs / 0.07 AS logit, power(least(1.0, greatest(0.0, (c.ct + 1) / 2)), 2.0) AS w
        FROM cosines c ANTI JOIN pos_g p ON p.step = c.step AND p.i = c.i AND p.j = c.j""",
    "negatives": """
        SELECT w.step, w.i, any_value(m.top) AS top, sum(w) / 1.0 AS sw, sum(w * exp(logit - m.top)) AS swe
        FROM weights w JOIN (SELECT step, i, max(logit) AS top FROM weights GROUP BY step, i) m USING (step, i)
        GROUP BY w.step, w.i""",
    "focal_pairs": """
        SELECT c.step, c.cs / 0.07 AS own, greatest(c.cs / 0.07, n.top) AS peak,
               n.swe / (n.sw + 1e-8) * exp(n.top - greatest(c.cs / 0.07, n.top)) AS miss
        FROM cosines c SEMI JOIN pos_g p ON p.step = c.step AND p.i = c.i AND p.j = c.j
        JOIN negatives n ON n.step = c.step AND n.i = c.i""",
    "loss_focal": """
        SELECT step, avg(-ln(exp(own - peak) / (exp(own - peak) + miss + 1e-8))) AS v FROM focal_pairs GROUP BY step""",
    "loss_sts": """
        SELECT g.step, g.rank, avg(power(c.cs - c.ct, 2)) AS v
        FROM graded g JOIN cosines c ON c.step = g.step AND c.i = g.rank * 24 + g.i AND c.j = g.rank * 24 + g.j
        GROUP BY g.step, g.rank""",
    "ranks_of": "SELECT DISTINCT step, rank FROM points",
    "losses": """
        SELECT r.step, r.rank, coalesce(k.v, 0) AS kl, coalesce(f.v, 0) AS focal, coalesce(d.v, 0) AS disp,
               coalesce(s.v, 0) AS sts, n.n_valid
        FROM ranks_of r JOIN valid_n n USING (step) LEFT JOIN loss_kl k USING (step)
        LEFT JOIN loss_focal f USING (step) LEFT JOIN loss_disp d USING (step)
        LEFT JOIN loss_sts s ON s.step = r.step AND s.rank = r.rank""",
    # --- evaluation
    "sims": """
        SELECT e.source_seq, e.row_ord, p.lang, e.label,
               round(list_dot_product(CAST(a.query AS DOUBLE[]), CAST(b.doc AS DOUBLE[])), 9) AS sim
        FROM ex e JOIN (VALUES ('en'), ('fr')) p(lang) ON starts_with(e.lang, p.lang)
        JOIN both_vec a ON a.text_id = e.ids[1] JOIN both_vec b ON b.text_id = e.ids[2]
        WHERE e.task = 'sts' AND e.label IS NOT NULL""",
    "sim_ranks": """
        SELECT lang, rank() OVER (PARTITION BY lang ORDER BY sim)
                     + (count(*) OVER (PARTITION BY lang, sim) - 1) / 2.0 AS rx,
               rank() OVER (PARTITION BY lang ORDER BY label)
                     + (count(*) OVER (PARTITION BY lang, label) - 1) / 2.0 AS ry
        FROM sims""",
    "correlations": """
        SELECT lang, count(*) AS n, CASE WHEN count(*) >= 3 THEN
               (avg(rx * ry) - avg(rx) * avg(ry)) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) END AS rho
        FROM sim_ranks GROUP BY lang""",
    "ret_set": """
        SELECT row_number() OVER (ORDER BY source_seq, row_ord) - 1 AS i, lang, ids[1] AS q_id, ids[2] AS p_id
        FROM (SELECT * FROM ex WHERE task = 'retrieval' ORDER BY source_seq, row_ord LIMIT 512)""",
    "ret_vec": """
        SELECT i, lang, CAST(q.query AS DOUBLE[]) AS q, CAST(p.doc AS DOUBLE[]) AS p
        FROM ret_set JOIN both_vec q ON q.text_id = q_id JOIN both_vec p ON p.text_id = p_id""",
    "ret_scores": """
        SELECT a.i, b.i AS j, round(list_dot_product(a.q, b.p), 9) AS s,
               round(list_dot_product(a.q, a.p), 9) AS own
        FROM ret_vec a CROSS JOIN ret_vec b""",
    "ret_ranks": """
        SELECT i, 1 + count(*) FILTER (WHERE j <> i AND (s > own OR (s = own AND j < i))) AS rank
        FROM ret_scores GROUP BY i""",
    "ret_metrics": """
        SELECT count(*) AS n, CASE WHEN count(*) >= 2 THEN avg(CAST(rank = 1 AS DOUBLE)) END AS recall_at_1,
               CASE WHEN count(*) >= 2 THEN avg(1.0 / rank) END AS mrr FROM ret_ranks""",
    # --- the letter encoder
    "to_encode": """
        SELECT text_id, 'doc' AS kind, text FROM texts UNION ALL SELECT text_id, 'query', text FROM prompted""",
    "job_rows": f"""
        SELECT {strip('text')} AS a, {strip('lang')} AS b, doc_id AS o FROM documents
        WHERE {is_text('text')} AND {is_text('lang')}""",
    "conv_rows": f"""
        SELECT {strip('role')} AS a, {strip('text')} AS b FROM conversations
        WHERE {is_text('role')} AND {is_text('text')}""",
    "job_split": """
        SELECT *, p < CASE WHEN n >= 100 THEN greatest(1, n // 100) ELSE 0 END AS in_val
        FROM (SELECT *, row_number() OVER (ORDER BY o) - 1 AS p, count(*) OVER () AS n FROM job_rows)""",
    "job_val": """
        SELECT * FROM (SELECT *, row_number() OVER (ORDER BY row_ord * 3 + source_seq) - 1 AS p, count(*) OVER () AS n FROM ex)
        WHERE p < CASE WHEN n >= 100 THEN greatest(1, n // 100) ELSE 0 END""",
    "job_pairs": f"""
        SELECT p.lang, label, {quoted(K.STUDENT_PROMPTS['sts'])} || texts[1] AS a, texts[2] AS b
        FROM job_val e JOIN (VALUES ('en'), ('fr')) p(lang) ON starts_with(e.lang, p.lang)
        WHERE task = 'sts' AND label IS NOT NULL""",
    "job_ret": f"""
        SELECT row_number() OVER (ORDER BY p) - 1 AS i, lang, {quoted(K.STUDENT_PROMPTS['ret'])} || texts[1] AS a, texts[2] AS b
        FROM job_val WHERE task = 'retrieval'""",
    "job_ret_vec": "SELECT i, CAST(LETTERS(a) AS DOUBLE[]) AS q, CAST(LETTERS(b) AS DOUBLE[]) AS v FROM job_ret",
    "job_scores": """
        SELECT a.i, b.i AS j, round(list_dot_product(a.q, b.v), 9) AS s, round(list_dot_product(a.q, a.v), 9) AS own
        FROM job_ret_vec a CROSS JOIN job_ret_vec b""",
    "job_metrics": """
        SELECT count(*) AS n, CASE WHEN count(*) >= 2 THEN avg(CAST(rank = 1 AS DOUBLE)) END AS recall_at_1,
               CASE WHEN count(*) >= 2 THEN avg(1.0 / rank) END AS mrr
        FROM (SELECT i, 1 + count(*) FILTER (WHERE j <> i AND (s > own OR (s = own AND j < i))) AS rank FROM job_scores GROUP BY i)""",
    "job_sims": """
        SELECT lang, label, round(list_dot_product(CAST(va AS DOUBLE[]), CAST(vb AS DOUBLE[])), 9) AS sim
        FROM (SELECT *, LETTERS(a) AS va, LETTERS(b) AS vb FROM job_pairs)""",
    "job_ranks": """
        SELECT lang, rank() OVER (PARTITION BY lang ORDER BY sim)
                     + (count(*) OVER (PARTITION BY lang, sim) - 1) / 2.0 AS rx,
               rank() OVER (PARTITION BY lang ORDER BY label)
                     + (count(*) OVER (PARTITION BY lang, label) - 1) / 2.0 AS ry
        FROM job_sims""",
    "letter_points": """
        SELECT step, rank, rank * 24 + local_idx AS g, CAST(LETTERS(student_text) AS DOUBLE[]) AS s,
               CAST(CASE WHEN use_query THEN v.query ELSE v.doc END AS DOUBLE[]) AS t
        FROM batch_rows JOIN both_vec v USING (text_id)""",
    "letter_cosines": """
        SELECT a.step, a.rank, a.g AS i, b.g AS j, list_cosine_similarity(a.t, b.t) AS ct,
               list_dot_product(a.s, b.s)
                   / greatest(sqrt(list_dot_product(a.s, a.s)) * sqrt(list_dot_product(b.s, b.s)), 1e-12) AS cs
        FROM letter_points a JOIN letter_points b ON a.step = b.step AND a.g <> b.g""",
}


def letters(text: str) -> str:
    """Unit vector of the counts of the letters a to z, in single precision."""
    counts = f"list_transform(range(97, 123), lambda c: CAST(len({text}) - len(replace({text}, chr(CAST(c AS INTEGER)), '')) AS DOUBLE))"
    return unit(counts)


def unit(vec: str) -> str:
    return (
        f"list_transform([{vec}], lambda v: list_transform(v, lambda x: "
        f"CAST(x / greatest(sqrt(list_dot_product(v, v)), 1e-12) AS FLOAT)))[1]"
    )


def half(x: str) -> str:
    """Round a single-precision number to half precision."""
    step = f"power(2.0, greatest(floor(log2(abs({x}))), -14) - 10)"
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x} / {step}, 0) * {step} END"


def expand(sql: str) -> str:
    return re.sub(r"LETTERS\((\w+)\)", lambda m: letters(m.group(1)), sql)


def compose(sql: str, instead: dict[str, str] | None = None) -> str:
    """The statement preceded by every building block it needs; ``instead`` has other texts for some."""
    blocks = {**CTES, **(instead or {})}
    needed: set[str] = set()
    todo = [sql]
    while todo:
        for name in set(re.findall(r"\w+", todo.pop())) & blocks.keys() - needed:
            needed.add(name)
            todo.append(blocks[name])
    parts = [f"{name} AS ({blocks[name]})" for name in blocks if name in needed]
    return expand((f"WITH {', '.join(parts)} " if parts else "") + sql)


FLAT = """SELECT CAST(source_seq AS BIGINT) AS source_seq, row_ord, example_id, task, lang, len(texts) AS n_texts,
    md5(array_to_string(texts, '|')) AS texts_md5, array_to_string(roles, ',') AS roles,
    array_to_string(tp, ',') AS teacher, array_to_string(sp, ',') AS student, label FROM """
KEY = "CAST(source_seq AS BIGINT) AS source_seq, row_ord"


def weighted(vec: str) -> str:
    """A sum over all components, each with a weight of its own."""
    return f"round(list_sum(list_transform({vec}, lambda x, i: CAST(x AS DOUBLE) * i)), 4)"


PROBE = f"""CAST(len(vec) AS BIGINT) AS dim, {weighted('vec')} AS weighted, round(CAST(vec[1] AS DOUBLE), 6) AS v0,
    round(CAST(vec[5] AS DOUBLE), 6) AS v4, round(CAST(vec[20] AS DOUBLE), 6) AS v19"""
OWN_STUDENT = {**K.STUDENT_PROMPTS, "ret": "find: "}
MEAN = """SELECT CAST(id AS BIGINT) AS id, dim, round(CAST(CAST(avg(CAST(vec[dim + 1] AS DOUBLE)) AS FLOAT) AS DOUBLE), 6) AS value
    FROM (SELECT *, unnest(range(0, 64)) AS dim FROM kept_tokens) GROUP BY 1, 2"""

ORACLES: dict[str, str] = {
    "q_source_cap": "SELECT doc_id AS row_ord, doc_id, lang, md5(text) AS text_md5 FROM documents WHERE doc_id < 150",
    "q_ingest_manifest": """
        SELECT CAST(s AS BIGINT) AS source_seq, g AS source_group, split, 'en' AS lang, CAST(n AS BIGINT) AS rows,
               status, status = 'ok' AS has_path
        FROM (SELECT 0 AS s, 'sts' AS g, 'documents' AS split, least(count(*), 300) AS n, 'ok' AS status FROM documents
              UNION ALL SELECT 1, 'retrieval', 'conversations', count(*), 'ok' FROM conversations
              UNION ALL SELECT 2, 'sts', 'labels', count(*), 'ok' FROM labels
              UNION ALL SELECT 3, 'bitext', 'absent', 0, 'error')""",
    "q_build_corpus": """
        SELECT (SELECT count(*) FROM job_rows) + (SELECT count(*) FROM conv_rows) AS n_examples,
               (SELECT count(DISTINCT t) FROM (SELECT a AS t FROM job_rows UNION ALL SELECT b FROM job_rows
                UNION ALL SELECT a FROM conv_rows UNION ALL SELECT b FROM conv_rows)) AS n_texts,
               'en-ko' AS languages, 'bitext' AS tasks""",
    "q_norm_sts": FLAT + "ex_sts",
    "q_norm_triples": FLAT + "ex_triples",
    "q_norm_passages": FLAT + "ex_passages",
    "q_norm_qa": FLAT + "ex_answers",
    "q_norm_bitext": FLAT + "ex_bitext",
    "q_strip_text": f"""
        SELECT doc_id, length(t) AS n, md5(t) AS text_md5
        FROM (SELECT doc_id, {strip("chr(32) || chr(9) || chr(31) || chr(8195) || text || chr(32) || chr(9) || chr(31) || chr(8195)")} AS t
              FROM documents)""",
    "q_union_routed": """
        SELECT CAST(s AS BIGINT) AS source_seq, task, lang, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_texts
        FROM (SELECT 0 AS s, task, lang, len(texts) AS k FROM ex_sts
              UNION ALL SELECT 1, 'retrieval', 'en', 2 + len(list_filter(negative[1:2], lambda x: trim(x) <> '')) FROM fx_triples
              UNION ALL SELECT 2, 'retrieval', 'en', 2 + len(list_filter(negative, lambda x: trim(x) <> '')[1:1]) FROM fx_triples
              UNION ALL SELECT 3, task, lang, len(texts) FROM ex_answers
              UNION ALL SELECT 4, task, lang, len(texts) FROM ex_bitext)
        GROUP BY s, task, lang""",
    "q_validate_errors": "SELECT coalesce(error, 'ok') AS error, count(*) AS n FROM bad GROUP BY 1",
    "q_quarantine": f"SELECT {KEY}, error FROM bad WHERE error IS NOT NULL",
    "q_accepted": f"SELECT {KEY}, example_id, CAST(NULL AS DOUBLE) AS label, true AS no_ids FROM bad WHERE error IS NULL",
    "q_unique_texts": """
        SELECT lang, count(*) AS n_texts, CAST(sum(n_uses) AS BIGINT) AS n_uses, CAST(sum(length(text)) AS BIGINT) AS n_chars
        FROM texts GROUP BY lang""",
    "q_distinct_texts": f"SELECT {KEY}, side, text_id, lang, md5(text) AS text_md5, n_uses FROM texts",
    "q_text_ids": f"SELECT {KEY}, array_to_string(ids, ',') AS text_ids FROM ex",
    "q_cap_texts": "SELECT text_id, lang FROM capped_texts",
    "q_cap_examples": f"""
        SELECT {KEY}, example_id FROM ex
        WHERE (source_seq, row_ord) NOT IN (SELECT (source_seq, row_ord) FROM sides
              WHERE text_id NOT IN (SELECT text_id FROM capped_texts))""",
    "q_split_shard": f"SELECT {KEY}, split, pos, shard FROM shards",
    "q_summary": """
        SELECT (SELECT count(*) FROM ex) AS n_examples, (SELECT count(*) FROM texts) AS n_texts,
               (SELECT string_agg(lang, ',' ORDER BY lang) FROM (SELECT DISTINCT lang FROM ex)) AS languages,
               (SELECT string_agg(task, ',' ORDER BY task) FROM (SELECT DISTINCT task FROM ex)) AS tasks""",
    "q_shard_roundtrip": """
        SELECT asked, fb AS fallback, split, shard, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos,
               count(label) AS n_labels
        FROM shards JOIN (VALUES ('train', false), ('val', false), ('test', true)) a(asked, fb) ON fb OR split = asked
        GROUP BY ALL""",
    "q_checksums": f"""
        SELECT split, shard, count(*) AS n, CAST(sum(CAST('0x' || substr(md5({SPELLED}), 1, 15) AS HUGEINT)) AS VARCHAR) AS digest,
               true AS whole
        FROM shards GROUP BY split, shard""",
    "q_example_at": f"""
        SELECT {KEY}, pos, example_id FROM split_ex WHERE split = 'train'
          AND (pos = 4 OR pos = (SELECT max(pos) FROM split_ex WHERE split = 'train'))""",
    "q_texts_roundtrip": "SELECT text_id, lang, md5(text) AS text_md5 FROM texts",
    "q_fallback": """
        SELECT 'full' AS source, task, lang, count(*) AS n FROM ex GROUP BY ALL
        UNION ALL SELECT 'empty', task, lang, count(*) FROM (VALUES ('sts', 'en'), ('sts', 'ko'), ('retrieval', 'en'),
              ('bitext', 'en-ko')) f(task, lang) WHERE NOT EXISTS (SELECT 1 FROM ex WHERE task = 'reranking')
        GROUP BY ALL""",
    "q_stride": """
        SELECT p % 3 AS rank, task, count(*) AS n, CAST(sum(p) AS BIGINT) AS sum_pos FROM placed GROUP BY ALL""",
    "q_first_rows": f"SELECT {KEY}, example_id FROM ex ORDER BY source_seq, row_ord LIMIT 40",
    "q_prompts": f"""
        SELECT {KEY}, side, {effective_prompt('role', 'sp')} AS student_prompt,
               md5({prefix_case(K.TEACHER_PROMPTS, 'tp')} || text) AS teacher_md5,
               md5({prefix_case(OWN_STUDENT, effective_prompt('role', 'sp'))} || text) AS student_md5 FROM sides""",
    "q_query_flags": f"""
        SELECT task, role, side, {USE_QUERY} AS use_query, count(*) AS n FROM sides GROUP BY ALL""",
    "q_query_prompted": f"""
        SELECT text_id, tp AS prompt_name, md5({prefix_case(K.TEACHER_PROMPTS, 'tp')} || text) AS text_md5
        FROM (SELECT s.*, row_number() OVER (PARTITION BY text_id
                     ORDER BY s.source_seq DESC, s.row_ord DESC, side DESC) AS rn
              FROM sides s JOIN split_ex x ON x.source_seq = s.source_seq AND x.row_ord = s.row_ord AND x.split = 'train'
              WHERE s.tp NOT IN ('document', 'None', 'nan') AND role IN ('query', 'sentence_a', 'sentence_b'))
        WHERE rn = 1""",
    "q_lang_filter": "SELECT task, lang, count(*) AS n FROM ex WHERE starts_with(lang, 'e') GROUP BY ALL",
    "q_task_registry": """
        SELECT task, student_prompt, teacher_prompt_query, teacher_prompt_doc, count(*) AS n
        FROM ex JOIN (VALUES ('sts', 'sts', 'sts_query', 'document'), ('retrieval', 'ret', 'web_search_query', 'document'),
             ('bitext', 'bitext', 'bitext_query', 'bitext_query'))
             r(task, student_prompt, teacher_prompt_query, teacher_prompt_doc) USING (task)
        GROUP BY ALL""",
    "q_language_registry": "SELECT lang, count(*) AS n FROM ex WHERE base NOT IN ('en', 'ko') GROUP BY lang",
    "q_encode_texts": f"""
        SELECT text_id, kind, {PROBE}
        FROM (SELECT text_id, kind, list_transform(LETTERS(text), lambda x: {half('x')}) AS vec FROM to_encode)""",
    "q_embed_job": """
        SELECT (SELECT count(DISTINCT t) FROM (SELECT a AS t FROM job_rows UNION ALL SELECT b FROM job_rows)) AS n,
               CAST(26 AS BIGINT) AS dim, 'float16' AS dtype,
               (SELECT count(DISTINCT t) FROM (SELECT a AS t FROM job_split WHERE NOT in_val
                UNION ALL SELECT b FROM job_split WHERE NOT in_val)) AS n_query""",
    "q_normalize_vectors": f"""
        SELECT vec_id, {PROBE} FROM (SELECT vec_id, {unit('CAST(list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * 3 AS FLOAT)) AS DOUBLE[])')} AS vec FROM embeddings)""",
    "q_half_precision": f"""
        SELECT vec_id, {PROBE} FROM (SELECT vec_id, list_transform(embedding, lambda x: {half('x')}) AS vec FROM embeddings)""",
    "q_mean_pool": MEAN,
    "q_last_pool": """
        SELECT CAST(id AS BIGINT) AS id, dim, round(CAST(vec[dim + 1] AS DOUBLE), 6) AS value
        FROM (SELECT id, arg_max(vec, pos) AS vec, unnest(range(0, 64)) AS dim FROM kept_tokens GROUP BY id)""",
    "q_row_numbers": "SELECT text_id, n AS row FROM numbered",
    "q_vector_lookup": f"""
        SELECT {KEY}, side, text_id, use_query, {PROBE}
        FROM (SELECT *, CASE WHEN use_query THEN query ELSE doc END AS vec
              FROM (SELECT *, {USE_QUERY} AS use_query FROM sides) JOIN both_vec USING (text_id))""",
    "q_overlay": f"""
        SELECT text_id, {weighted('doc')} AS doc_weighted, {weighted('query')} AS query_weighted, round(CAST(doc[1] AS DOUBLE), 6) AS doc0, round(CAST(query[1] AS DOUBLE), 6) AS query0,
               round(CAST(query[64] AS DOUBLE), 6) AS query63 FROM both_vec""",
    "q_vector_missing": f"SELECT {KEY}, side, text_id FROM sides WHERE text_id NOT IN (SELECT text_id FROM doc_vec)",
    "q_vector_present": """
        SELECT task, lang, count(*) AS n FROM sides WHERE text_id IN (SELECT text_id FROM doc_vec) GROUP BY ALL""",
    "q_embedding_roundtrip": """
        SELECT (SELECT count(*) FROM doc_vec) AS n, CAST(64 AS BIGINT) AS dim, 'float32' AS dtype,
               (SELECT count(*) FROM query_vec) AS n_query""",
    "q_batch_slots": f"SELECT {KEY}, step, rank, slot FROM full_batches",
    "q_batches": f"""
        SELECT {KEY}, step, rank, local_idx, side, role, text_id, md5(student_text) AS student_md5, use_query FROM batch_rows""",
    "q_positive_pairs": "SELECT step, rank, i, j FROM positives",
    "q_sts_pairs": "SELECT step, rank, i, j FROM graded",
    "q_global_pairs": """
        SELECT step, rank * 24 + i AS gi, rank * 24 + j AS gj, 'positive' AS kind FROM positives
        UNION ALL SELECT step, rank * 24 + i, rank * 24 + j, 'graded' FROM graded""",
    "q_kl": """
        SELECT step, round(coalesce(v, 0), 6) AS loss_kl, n_valid FROM valid_n LEFT JOIN loss_kl USING (step)""",
    "q_focal": """
        SELECT step, round(coalesce(v, 0), 6) AS loss_focal, n_valid FROM valid_n LEFT JOIN loss_focal USING (step)""",
    "q_disperse": """
        SELECT step, round(coalesce(v, 0), 6) AS loss_disp, n_valid FROM valid_n LEFT JOIN loss_disp USING (step)""",
    "q_pair_mse": """
        SELECT r.step, r.rank, round(coalesce(v, 0), 6) AS loss_sts
        FROM ranks_of r LEFT JOIN loss_sts s ON s.step = r.step AND s.rank = r.rank""",
    "q_loss_bundle": """
        SELECT step, rank, round(kl, 6) AS loss_kl, round(focal, 6) AS loss_focal, round(disp, 6) AS loss_disp,
               round(sts, 6) AS loss_sts, round(kl + 0.5 * focal + 0.01 * disp + sts, 6) AS loss,
               CAST(48 AS BIGINT) AS n, n_valid FROM losses""",
    "q_step_report": """
        SELECT step, round(kl + 0.5 * focal + 0.01 * disp + sts, 6) AS loss, CAST(48 AS BIGINT) AS n, n_valid
        FROM losses WHERE rank = 0 AND step % 5 = 0""",
    "q_pairwise_cosine": """
        SELECT a.step, a.idx, count(*) AS n, round(sum(list_cosine_similarity(a.v, b.v)), 6) AS total,
               round(min(list_cosine_similarity(a.v, b.v)), 6) AS lowest,
               round(max(list_cosine_similarity(a.v, b.v)) FILTER (a.idx <> b.idx), 6) AS highest
        FROM (SELECT vec_id // 64 AS step, vec_id % 64 AS idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a
        JOIN (SELECT vec_id // 64 AS step, vec_id % 64 AS idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b USING (step)
        GROUP BY a.step, a.idx""",
    "q_sts_similarity": f"SELECT {KEY}, lang, label, round(sim, 6) AS sim FROM sims",
    "q_sts_spearman": """
        SELECT p.lang, coalesce(n, 0) AS n, round(rho, 6) AS spearman, coalesce(n, 0) < 50 AS low_sample
        FROM (VALUES ('en'), ('fr'), ('ko')) p(lang) LEFT JOIN correlations USING (lang)""",
    "q_retrieval_ranks": "SELECT i, rank FROM ret_ranks",
    "q_retrieval_eval": "SELECT n, round(recall_at_1, 6) AS recall_at_1, round(mrr, 6) AS mrr FROM ret_metrics",
    "q_eval_lang_counts": "SELECT lang, count(*) AS n FROM ret_set GROUP BY lang",
    "q_eval_report": """
        SELECT 'student' AS model, false AS fallback, p.lang, coalesce(c.n, 0) AS n, round(c.rho, 6) AS spearman,
               coalesce(c.n, 0) < 50 AS low_sample, m.n AS queries,
               (SELECT count(*) FROM ex WHERE task = 'retrieval') AS available, round(m.recall_at_1, 6) AS recall_at_1,
               round(m.mrr, 6) AS mrr,
               (SELECT string_agg(lang || '=' || k, ',' ORDER BY lang)
                FROM (SELECT lang, count(*) AS k FROM ret_vec GROUP BY lang)) AS by_lang
        FROM (VALUES ('en'), ('fr')) p(lang) LEFT JOIN correlations c USING (lang) CROSS JOIN ret_metrics m""",
    "q_eval_job": """
        SELECT 'student' AS model, false AS fallback, p.lang, coalesce(r.n, 0) AS n,
               round(rho, 6) AS spearman, coalesce(r.n, 0) < 50 AS low_sample,
               m.n AS queries, m.n AS available, round(m.recall_at_1, 6) AS recall_at_1, round(m.mrr, 6) AS mrr,
               (SELECT coalesce(string_agg(lang || '=' || k, ',' ORDER BY lang), '')
                FROM (SELECT lang, count(*) AS k FROM job_ret GROUP BY lang)) AS by_lang
        FROM (VALUES ('en'), ('fr')) p(lang) CROSS JOIN job_metrics m
        LEFT JOIN (SELECT lang, count(*) AS n, CASE WHEN count(*) >= 3 THEN
                   (avg(rx * ry) - avg(rx) * avg(ry)) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) END AS rho
                   FROM job_ranks GROUP BY lang) r USING (lang)""",
    "q_pairs_without_roles": """
        SELECT step, rank, i, j, 'positive' AS kind FROM positives UNION ALL SELECT step, rank, i, j, 'graded' FROM graded""",
    "q_encoder_losses": """
        SELECT step, rank, round(kl, 6) AS loss_kl, round(focal, 6) AS loss_focal, round(disp, 6) AS loss_disp,
               round(sts, 6) AS loss_sts, n_valid FROM losses""",
}


#: Sentence roles taken away; the encoder's vectors in place of the student table's.
INSTEAD = {
    "q_pairs_without_roles": {
        "ex": f"""SELECT * REPLACE (CASE WHEN task IN ('sts', 'bitext') AND row_ord % 3 = 0
            THEN list_transform(roles, lambda r: 'document') ELSE roles END AS roles) FROM ({CTES['ex']})""",
    },
    "q_encoder_losses": {
        "points": CTES["letter_points"],
        "cosines": CTES["letter_cosines"].replace("letter_points", "points"),
    }
}


def oracle_sql() -> dict[str, str]:
    return {name: compose(sql, INSTEAD.get(name)) for name, sql in ORACLES.items()}
