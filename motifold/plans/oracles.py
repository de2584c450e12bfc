"""DuckDB SQL for the engine's queries, written from the definitions and not from the Spark code."""

from __future__ import annotations

from motifold.functions.flexibility import feature_names, features

_SEQ = "seqs AS (SELECT doc_id, source, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"
_SEQN = "seqs AS (SELECT doc_id, source, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS seq FROM documents)"
_TOK = "tok AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, substr(seq, pos + 1, 6) AS kmer FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 5)) AS pos FROM seqs WHERE length(seq) >= 6))"
_WIN = "win AS (SELECT doc_id, j, substr(seq, 36 * j + 1, 36) AS seq FROM (SELECT doc_id, seq, unnest(range(0, (length(seq) + 35) // 36)) AS j FROM seqs))"
_LOOK = "look(i, feature, n, word, value) AS (VALUES " + ", ".join(f"({f.index}, '{f.name}', {f.width}, '{w}', {v!r}::DOUBLE)" for f in features() for w, v in sorted(f.values.items())) + ")"
#: Means of each distinct k-mer, from its words.
_KMER = (
    "kw AS (SELECT kmer, f.feature, f.i, f.n, unnest(range(1, 8 - f.n)) AS o FROM (SELECT DISTINCT kmer FROM tok), (SELECT DISTINCT feature, i, n FROM look) f), "
    "kf AS (SELECT kmer, kw.feature, kw.i, avg(coalesce(look.value, 0)) AS value FROM kw LEFT JOIN look ON look.feature = kw.feature AND look.word = substr(kmer, o, kw.n) GROUP BY ALL)"
)
_CODE = "CASE WHEN regexp_full_match(kmer, '[ACGT]{6}') THEN 4 + list_sum(list_transform(range(1, 7), lambda i: CAST(pow(4, 6 - i) AS INTEGER) * (strpos('ACGT', substr(kmer, i, 1)) - 1))) ELSE 3 END"


def _draw(seed: int | str, *keys: str) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 8)) AS BIGINT)"


def _unit(seed: int | str, *keys: str) -> str:
    return f"({_draw(seed, *keys)} / 4294967296.0::DOUBLE)"


ORACLES: dict[str, str] = {}
O = ORACLES  # noqa: E741
O["kmer_tokens"] = f"WITH {_SEQ}, {_TOK} SELECT doc_id, pos, kmer FROM tok"
O["kmer_token_ids"] = f"WITH {_SEQN}, {_TOK} SELECT doc_id, pos, CAST({_CODE} AS INTEGER) AS token_id FROM tok"
O["kmer_token_ids_cls"] = f"WITH {_SEQN}, {_TOK} SELECT doc_id, CAST(pos + 1 AS INTEGER) AS pos, CAST({_CODE} AS INTEGER) AS token_id FROM tok UNION ALL SELECT doc_id, 0, 1 FROM documents"
O["kmer_vocab"] = f"""WITH {_SEQ}, {_TOK}, c AS (SELECT kmer, count(*) AS n FROM tok GROUP BY kmer), b(x) AS (VALUES ('A'), ('C'), ('G'), ('T')), k AS (SELECT a.x || b.x || c.x || d.x || e.x || f.x AS token FROM b a, b, b c, b d, b e, b f),
v AS (SELECT token, CAST(3 + row_number() OVER (ORDER BY token) AS INTEGER) AS token_id FROM k UNION ALL VALUES ('[PAD]', 0), ('[CLS]', 1), ('[MASK]', 2), ('[UNK]', 3))
SELECT token, token_id, coalesce(n, 0) AS n FROM v LEFT JOIN c ON c.kmer = v.token"""
O["kmer_counts_topk"] = f"WITH {_SEQ}, {_TOK} SELECT kmer, count(*) AS n FROM tok GROUP BY kmer ORDER BY n DESC, kmer LIMIT 20"
_SEEN = "w AS (SELECT n AS width, substr(seq, pos, n) AS word, count(*) AS seen FROM (SELECT seq, n, unnest(range(1, length(seq) + 2 - n)) AS pos FROM seqs, (VALUES (2), (3)) t(n)) GROUP BY 1, 2)"
O["flex_lookup_profile"] = f"""WITH {_SEQ}, {_LOOK}, {_SEEN} SELECT feature, count(*) AS n, CAST(sum(coalesce(seen, 0)) AS BIGINT) AS seen, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean,
round(sum(value * coalesce(seen, 0)) / sum(coalesce(seen, 0)), 6) AS mean_seen FROM look LEFT JOIN w ON w.word = look.word GROUP BY feature"""
_WIDE = ", ".join(f"max(CASE WHEN kf.i = {i} THEN kf.value END) AS {n}" for i, n in enumerate(feature_names()))
_TOLD = ", ".join(f"round(avg(wide.{n}) + 1.3e-7, 4) + 0.0 AS {n}, round(sum(wide.{n} * (pos + 1)) / sum(pos + 1) + 1.3e-7, 4) + 0.0 AS {n}_by_place" for n in feature_names())
for _name, _base in (("flex_token_targets", _SEQ), ("flex_token_targets_lenient", _SEQN)):
    O[_name] = f"WITH {_base}, {_TOK}, {_LOOK}, {_KMER}, wide AS (SELECT kmer, CAST({_CODE.replace('kmer', 'kf.kmer')} AS INTEGER) AS id, {_WIDE} FROM kf GROUP BY kmer) SELECT doc_id, count(*) AS n, CAST(sum(wide.id) AS BIGINT) AS ids, {_TOLD} FROM tok JOIN wide ON wide.kmer = tok.kmer GROUP BY doc_id"
O["flex_track_profile"] = f"""WITH {_SEQ}, {_WIN}, {_LOOK},
f AS (SELECT DISTINCT feature, i, n FROM look),
ls AS (SELECT DISTINCT length(seq) AS l FROM win),
p AS (SELECT l, feature, n, unnest(range(0, l + 1 - n)) AS pos, (SELECT coalesce(sum(l + 1 - g.n), 0) FROM f g WHERE g.n > f.n OR (g.n = f.n AND g.i < f.i)) AS before FROM f, ls WHERE l >= n)
SELECT p.feature, CAST(p.pos AS INTEGER) AS pos, CAST(p.before + p.pos AS INTEGER) AS place, count(*) AS n, round(avg(coalesce(look.value, 0)) + 1.3e-7, 6) + 0.0 AS mean
FROM win JOIN p ON p.l = length(win.seq) LEFT JOIN look ON look.feature = p.feature AND look.word = substr(win.seq, p.pos + 1, p.n) GROUP BY ALL"""
_STATS = (
    "c AS (SELECT kmer, count(*) AS times FROM tok GROUP BY kmer), m AS (SELECT feature, sum(times) AS n, sum(value * times) / sum(times) AS mean FROM kf JOIN c ON c.kmer = kf.kmer GROUP BY feature), "
    "st AS (SELECT kf.feature, any_value(m.n) AS n, any_value(m.mean) AS mean, sqrt(sum(times * pow(value - m.mean, 2)) / sum(times)) AS std FROM kf JOIN c ON c.kmer = kf.kmer JOIN m ON m.feature = kf.feature GROUP BY kf.feature)"
)
O["flex_norm_stats"] = f"WITH {_SEQ}, {_TOK}, {_LOOK}, {_KMER}, {_STATS} SELECT feature, CAST(n AS BIGINT) AS n_tokens, round(mean, 6) AS mean, round(CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS std FROM st"
_OWN = "own AS (SELECT doc_id, feature, avg(value) AS mean, stddev_pop(value) AS s, min(value) AS low, max(value) AS high, arg_min(value, pos) AS first, sum(value * (pos + 1)) / sum(pos + 1) AS by_place FROM tok JOIN kf ON kf.kmer = tok.kmer GROUP BY ALL)"
O["flex_normalized_global"] = f"WITH {_SEQ}, {_TOK}, {_LOOK}, {_KMER}, {_STATS}, {_OWN} SELECT doc_id, own.feature, round((own.mean - st.mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) + 0.0 AS z FROM own JOIN st ON st.feature = own.feature"
O["flex_normalized_tokens"] = f"WITH {_SEQ}, {_TOK}, {_LOOK}, {_KMER}, {_STATS}, z AS (SELECT doc_id, pos, kf.feature, (value - st.mean) / CASE WHEN std = 0 THEN 1 ELSE std END AS z FROM tok JOIN kf ON kf.kmer = tok.kmer JOIN st ON st.feature = kf.feature) SELECT doc_id, feature, round(avg(z) + 1.3e-7, 4) + 0.0 AS z, round(avg(z * (pos % 7)) + 1.3e-7, 4) + 0.0 AS z_by_place FROM z GROUP BY 1, 2"
_Z = ", ".join(f"round(({c} - mean) / CASE WHEN round(s, 9) = 0 THEN 1 ELSE s END, 5) + 0.0 AS z_{c}" for c in ("low", "high", "first"))
O["flex_zscore_per_seq"] = f"WITH {_SEQ}, {_TOK}, {_LOOK}, {_KMER}, {_OWN} SELECT doc_id, feature, {_Z}, round((by_place - mean) / CASE WHEN round(s, 9) = 0 THEN 1 ELSE s END + 1.3e-7, 4) + 0.0 AS z_by_place FROM own"
O["onehot_profile"] = f"WITH {_SEQN}, {_TOK}, p AS (SELECT unnest(range(0, 24)) AS place) SELECT CAST(place AS INTEGER) AS place, count(*) AS n, count(*) FILTER (substr(kmer, place // 4 + 1, 1) = substr('ACGT', place % 4 + 1, 1)) AS hits FROM tok, p GROUP BY place"
for _n in (1, 2, 3):
    _sum = " + ".join(f"{4 ** (_n - i)} * (strpos('ACGT', substr(seq, pos + {i}, 1)) - 1)" for i in range(1, _n + 1))
    O[f"positional_nmer_{_n}"] = f"WITH {_SEQ}, {_WIN}, q AS (SELECT seq, unnest(range(0, length(seq) + 1 - {_n})) AS pos FROM win) SELECT CAST(pos * {4**_n} + {_sum} AS INTEGER) AS place, count(*) AS hits FROM q GROUP BY 1"
O["valid_acgt_words"] = r"SELECT doc_id, count(*) AS n_words, count(*) FILTER (regexp_full_match(word, '[ACGT]*')) AS n_valid FROM (SELECT doc_id, unnest(regexp_split_to_array(upper(text), '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY doc_id"
_LINES = f"""{_SEQ}, src AS (SELECT s.doc_id, s.source AS file, s.seq, d.n_chars, 8 + s.doc_id % 7 AS size FROM seqs s JOIN documents d ON d.doc_id = s.doc_id),
pc AS (SELECT doc_id, file, n_chars, j, substr(seq, j * size + 1, size) AS seq FROM (SELECT *, unnest(range(0, (length(seq) + size - 1) // size)) AS j FROM src)),
ln AS (SELECT doc_id * 100000 + j AS line, file, CASE (doc_id + j) % 5 WHEN 0 THEN '  ' WHEN 1 THEN seq WHEN 2 THEN seq || ' x1'
  ELSE seq || chr(9) || CAST(CAST(n_chars / 4.0 + j AS DECIMAL(12, 2)) AS VARCHAR) || ' ' || doc_id END AS value FROM pc),
pt AS (SELECT line, file, regexp_split_to_array(regexp_replace(value, '^\\s+|\\s+$', '', 'g'), '\\s+') AS p, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS v FROM ln),
jd AS (SELECT line, file, upper(p[1]) AS seq, TRY_CAST(p[2] AS DOUBLE) AS score, TRY_CAST(p[3] AS DOUBLE) AS third,
  CASE WHEN v = '' THEN 'blank' WHEN len(p) < 2 THEN 'fields' WHEN TRY_CAST(p[2] AS DOUBLE) IS NULL THEN 'score' END AS why FROM pt)"""
O["scan_rejects"] = f"WITH {_LINES} SELECT file, coalesce(why, CASE WHEN length(seq) < 6 THEN 'short' ELSE 'row' END) AS reason, count(*) AS n FROM jd GROUP BY 1, 2"
_DOMINANT = "c AS (SELECT file, length(seq) AS length, count(*) AS n, min(line) AS first FROM jd WHERE why IS NULL AND length(seq) >= 6 GROUP BY 1, 2), dom AS (SELECT file, length, n FROM c QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, first) = 1)"
O["dominant_length"] = f"WITH {_LINES}, {_DOMINANT} SELECT file, CAST(length AS INTEGER) AS length, n FROM dom"
O["dominant_rows"] = f"WITH {_LINES}, {_DOMINANT} SELECT jd.file, count(*) AS n, CAST(min(length(jd.seq)) AS INTEGER) AS length, CAST(sum(line) AS BIGINT) AS lines, round(avg(score), 4) AS score FROM jd JOIN dom ON dom.file = jd.file AND dom.length = length(jd.seq) WHERE why IS NULL GROUP BY 1"
O["file_summaries"] = f"""WITH {_LINES}, k AS (SELECT *, coalesce(why, CASE WHEN length(seq) < 1 THEN 'short' END) AS reason FROM jd WHERE coalesce(why, '') <> 'blank'),
h AS (SELECT file, length(seq) AS l, count(*) AS n FROM k WHERE reason IS NULL GROUP BY 1, 2),
t AS (SELECT file, arg_max(l, n * 1000 - l) AS top_length, string_agg(l || ':' || n, ',' ORDER BY l) AS length_counts FROM h GROUP BY file),
s AS (SELECT file, count(*) FILTER (reason IS NULL) AS usable_rows, count(*) FILTER (reason IS NOT NULL) AS bad_rows, min(score) FILTER (reason IS NULL) AS score_min, max(score) FILTER (reason IS NULL) AS score_max,
  count(third) FILTER (reason IS NULL) AS third_col_present_rows, min(third) FILTER (reason IS NULL) AS third_col_min, max(third) FILTER (reason IS NULL) AS third_col_max FROM k GROUP BY file)
SELECT s.*, CAST(t.top_length AS INTEGER) AS top_length, t.length_counts FROM s LEFT JOIN t ON t.file = s.file"""
O["min_rows_files"] = f"WITH {_LINES} SELECT file, count(*) AS n, count(*) >= 20 AS enough FROM jd WHERE why IS NULL AND length(seq) >= 6 GROUP BY file"
O["genome_windows_sampled"] = f"""WITH {_SEQN}, c AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, seq, length(seq) AS size, row_number() OVER (ORDER BY {_draw(42, "CAST(doc_id AS VARCHAR)")}, CAST(doc_id AS VARCHAR)) - 1 AS at, regexp_matches(seq, '[ACGT]{{36}}') AS any FROM seqs WHERE length(seq) > 0),
t AS (SELECT unnest(range(0, 500000)) AS id), k AS (SELECT count(*) AS n FROM c),
p AS (SELECT t.id, c.chrom, c.seq, c.size, CAST(floor({_unit("42s", "t.id")} * (c.size - 35)) AS BIGINT) AS start FROM t, k JOIN c ON c.at = CAST(floor({_unit("42c", "t.id")} * k.n) AS BIGINT) WHERE c.size >= 36 AND c.any)
SELECT id AS draw, chrom, start, substr(seq, start + 1, 36) AS seq FROM p WHERE regexp_full_match(substr(seq, start + 1, 36), '[ACGT]*') ORDER BY id LIMIT 1000"""


def _split(seed: int, first: str, second: str) -> str:
    return f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_draw(seed, 'doc_id')}, doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= {first} THEN 'train' WHEN k <= {first} + {second} THEN 'val' ELSE 'test' END AS split FROM r"


O["split_train_val_test"] = _split(42, "floor(n * 0.8)", "floor(n * 0.1)")
O["split_bankers"] = _split(7, "round_even(n * 0.7, 0)", "round_even(n * 0.15, 0)")
O["kfold_assign"] = f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {_draw(42, 'o_orderkey')}, o_orderkey) - 1) % 10 AS INTEGER) AS fold FROM orders"
O["kfold_within"] = f"SELECT source, doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY {_draw(43, 'doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents"
O["nested_subsets"] = f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_draw(42, 'doc_id')}, doc_id) AS k, count(*) OVER () AS n FROM documents), p(percent) AS (VALUES (1), (5), (10), (25), (50), (100)) SELECT percent, doc_id FROM r, p WHERE k <= least(n, greatest(16, ceil(n * percent / 100.0)))"
O["row_cap"] = f"SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_draw(42, 'doc_id')}, doc_id) <= 10"
O["independent_subsets"] = (
    " UNION ALL ".join(f"SELECT '{n}' AS size, doc_id FROM (SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY {_draw(f'1042n{n}', 'doc_id')}, doc_id) <= {n})" for n in (50, 100))
    + " UNION ALL SELECT '1000000000', doc_id FROM documents"
)


def _masks(seed: int) -> str:
    return f"""WITH {_SEQ}, {_TOK}, d AS (SELECT doc_id, pos, CAST({_CODE} AS INTEGER) AS token_id, {_draw(seed, "doc_id", "pos")} AS u FROM tok),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY u, pos) AS k FROM d), m AS (SELECT *, u / 4294967296.0::DOUBLE < 0.15 OR (k = 1) AS masked FROM r)"""


O["mlm_mask"] = f"{_masks(42)} SELECT doc_id, pos, masked, CASE WHEN masked THEN token_id END AS label FROM m"
O["eval_mask"] = f"{_masks(12345)} SELECT doc_id, count(*) FILTER (masked) AS n, CAST(sum(token_id) FILTER (masked) AS BIGINT) AS labels, CAST(sum(pos) FILTER (masked) AS BIGINT) AS places FROM m GROUP BY doc_id"
O["fixed_mask"] = f"WITH {_SEQ} SELECT doc_id, CAST(CASE WHEN length(seq) > 5 THEN least(2, length(seq) - 6) END AS INTEGER) AS pos FROM seqs"
O["masked_pool"] = """WITH e AS (SELECT label, vec_id % 3 AS mask, unnest(range(0, 64)) AS place, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT label, CAST(place AS INTEGER) AS place, round(coalesce(sum(v) FILTER (mask <> 0), 0) / greatest(count(v) FILTER (mask <> 0), 1), 6) AS mean, round(coalesce(max(v) FILTER (mask <> 0), -1e9), 6) AS max FROM e GROUP BY 1, 2"""
_SCALED = f"""WITH e AS (SELECT vec_id, unnest(range(0, 65)) AS place, CAST(unnest(list_prepend(1.0, embedding)) AS DOUBLE) AS v FROM embeddings),
m AS (SELECT place, avg(v) AS mean, stddev_pop(v) AS s FROM e WHERE {_unit(42, "vec_id")} < 0.8 GROUP BY place)"""
O["standardize_train_apply"] = f"{_SCALED} SELECT vec_id, CAST(e.place AS INTEGER) AS place, round((v - mean) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 5) + 0.0 AS value FROM e JOIN m ON m.place = e.place"
O["standardize_drop_zero_var"] = f"{_SCALED} SELECT vec_id, CAST(e.place - 1 AS INTEGER) AS place, round((v - mean) / s, 5) + 0.0 AS value FROM e JOIN m ON m.place = e.place WHERE s > 1e-8"
_PRED = "x AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"
O["metrics_by_group"] = f"""WITH {_PRED}, a AS (SELECT l_returnflag, count(*) AS n, sum(pow(y - p, 2)) AS sse, sum(pow(y - my, 2)) AS sst, avg(pow(y - p, 2)) AS mse, covar_pop(y, p) AS c, stddev_pop(y) * stddev_pop(p) AS s
  FROM (SELECT *, avg(y) OVER (PARTITION BY l_returnflag) AS my FROM x) GROUP BY 1)
SELECT l_returnflag, n, round(1 - sse / greatest(sst, 1e-12), 6) AS r2, round(1 - sse / (sst + 1e-12), 6) AS r2_add, round(CASE WHEN s > 0 THEN c / s ELSE 0 END, 6) AS pearson, round(c / (s + 1e-12), 6) AS pearson_added, round(sqrt(mse), 3) AS rmse FROM a"""
O["metrics_zero_variance"] = "SELECT event_type, CAST(NULL AS DOUBLE) AS r2_null_p, 0.0::DOUBLE AS r2_exact_p, CAST(NULL AS DOUBLE) AS r2_null_same, 1.0::DOUBLE AS r2_exact_same, 0.0::DOUBLE AS pearson, CAST(NULL AS DOUBLE) AS pearson_null, 1.0::DOUBLE AS rmse FROM events GROUP BY event_type"
O["affine_calibration"] = f"WITH {_PRED} SELECT l_linestatus, round(covar_pop(p, y) / var_pop(p), 6) AS slope, 1.0::DOUBLE AS flat_slope, round(avg(y) - covar_pop(p, y) / var_pop(p) * avg(p), 3) AS intercept, round(avg(y) - 1, 3) AS flat_intercept FROM x GROUP BY 1"
O["scatter_fit_line"] = f"WITH {_PRED} SELECT l_returnflag, round(covar_pop(p, y) / var_pop(y), 6) AS slope, round(avg(p) - covar_pop(p, y) / var_pop(y) * avg(y), 3) AS intercept FROM x GROUP BY 1"
_FOLDED = f"""WITH r AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, (row_number() OVER (ORDER BY {_draw(42, "concat_ws('-', l_orderkey, l_linenumber, l_partkey)")}, concat_ws('-', l_orderkey, l_linenumber, l_partkey)) - 1) % 10 AS fold FROM lineitem)"""
_CELLS = f"""{_FOLDED},
t AS (SELECT l_returnflag, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM r WHERE fold < 8 GROUP BY 1),
v AS (SELECT l_returnflag, x, y, avg(y) OVER (PARTITION BY l_returnflag) AS my FROM r WHERE fold = 8),
f AS (SELECT l_returnflag, a, i, sxy / (sxx + a) AS w, my - sxy / (sxx + a) * mx AS b FROM t, (VALUES (0.1, 0), (100.0, 1), (10000.0, 2), (1000000.0, 3)) g(a, i)),
s AS (SELECT f.l_returnflag, i, any_value(w) AS w, 1 - sum(pow(v.y - w * v.x - b, 2)) / sum(pow(v.y - v.my, 2)) AS r2 FROM f JOIN v ON v.l_returnflag = f.l_returnflag GROUP BY 1, 2)"""
O["ridge_1d_alpha_sweep"] = f"{_CELLS} SELECT l_returnflag, " + ", ".join(f"round(max(w) FILTER (i = {i}), 3) AS slope_{i}, round(max(r2) FILTER (i = {i}), 6) AS r2_{i}" for i in range(4)) + ", 'ok' AS status FROM s GROUP BY 1"
O["calibrated_test"] = f"""{_FOLDED},
c AS (SELECT l_returnflag, covar_pop(x, y) / var_pop(x) AS w, avg(y) - covar_pop(x, y) / var_pop(x) * avg(x) AS b FROM r WHERE fold = 8 GROUP BY 1),
e AS (SELECT r.l_returnflag, y, w * x + b AS p, avg(y) OVER (PARTITION BY r.l_returnflag) AS my FROM r JOIN c ON c.l_returnflag = r.l_returnflag WHERE fold = 9)
SELECT l_returnflag, count(*) AS n, round(1 - sum(pow(y - p, 2)) / sum(pow(y - my, 2)), 6) AS r2, round(sqrt(avg(pow(y - p, 2))), 3) AS rmse FROM e GROUP BY 1"""
_ALPHAS = "g(a, i) AS (VALUES (0.1::DOUBLE, 0), (1.0, 1), (10.0, 2), (100.0, 3), (1000.0, 4), (10000.0, 5))"
_LINE = "count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx"
O["ridge_val_select"] = f"""{_FOLDED}, z AS (SELECT l_returnflag, x * 0.001 AS x, y, fold FROM r), {_ALPHAS},
t AS (SELECT l_returnflag, {_LINE} FROM z WHERE fold < 8 GROUP BY 1), u AS (SELECT l_returnflag, {_LINE} FROM z WHERE fold < 9 GROUP BY 1),
v AS (SELECT l_returnflag, x, y, avg(y) OVER (PARTITION BY l_returnflag) AS own FROM z WHERE fold = 8),
s AS (SELECT v.l_returnflag, i, any_value(a) AS a, 1 - sum(pow(y - my - sxy / (sxx + a) * (x - mx), 2)) / sum(pow(y - own, 2)) AS r2 FROM v JOIN t ON t.l_returnflag = v.l_returnflag, g GROUP BY 1, 2),
b AS (SELECT l_returnflag, a, r2 FROM s QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY r2 DESC, i) = 1),
e AS (SELECT z.l_returnflag, y, my + sxy / (sxx + a) * (x - mx) AS p, avg(y) OVER (PARTITION BY z.l_returnflag) AS own FROM z JOIN u ON u.l_returnflag = z.l_returnflag JOIN b ON b.l_returnflag = z.l_returnflag WHERE fold = 9),
o AS (SELECT l_returnflag, 1 - sum(pow(y - p, 2)) / sum(pow(y - own, 2)) AS r2, covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p)) AS c, sqrt(avg(pow(y - p, 2))) AS q FROM e GROUP BY 1)
SELECT b.l_returnflag, a AS alpha, round(b.r2, 6) AS val_r2, round(o.r2, 6) AS test_r2, round(c, 6) AS test_pearson, round(q, 3) AS test_rmse, 'ok' AS status FROM b JOIN o ON o.l_returnflag = b.l_returnflag"""
O["ridge_iterative_select"] = O["ridge_val_select"]
O["onehot_cooccurrence"] = f"""WITH {_SEQ}, {_WIN}, q AS (SELECT doc_id, j, 4 * pos + strpos('ACGT', substr(seq, pos + 1, 1)) - 1 AS place FROM (SELECT *, unnest(range(0, length(seq))) AS pos FROM win))
SELECT CAST(a.place AS INTEGER) AS i, CAST(b.place AS INTEGER) AS j, count(*) AS n FROM q a JOIN q b ON b.doc_id = a.doc_id AND b.j = a.j AND b.place >= a.place GROUP BY 1, 2"""
_VECTOR = f"e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(label AS DOUBLE) AS y, (row_number() OVER (ORDER BY {_draw(42, 'vec_id')}, vec_id) - 1) % 10 AS fold FROM embeddings)"
_SALTED = "concat_ws('|', CAST(held + 43 AS VARCHAR), CAST(vec_id AS VARCHAR))"
#: Ten outer folds; in each, its training rows in five inner ones; a line for each inner fold and penalty.
O["nested_cv_ridge_1d"] = f"""WITH {_VECTOR}, {_ALPHAS}, o AS (SELECT unnest(range(0, 10)) AS held), h AS (SELECT unnest(range(0, 5)) AS f),
tr AS (SELECT held, x, y, (row_number() OVER (PARTITION BY held ORDER BY {_draw(42, _SALTED)}, {_SALTED}) - 1) % 5 AS part FROM e, o WHERE fold <> held),
t AS (SELECT held, f, {_LINE} FROM tr, h WHERE part <> f GROUP BY 1, 2),
v AS (SELECT held, part, x, y, avg(y) OVER (PARTITION BY held, part) AS own FROM tr),
s AS (SELECT v.held, part, i, any_value(a) AS a, 1 - sum(pow(y - my - sxy / (sxx + a) * (x - mx), 2)) / sum(pow(y - own, 2)) AS r2 FROM v JOIN t ON t.held = v.held AND t.f = v.part, g GROUP BY 1, 2, 3),
b AS (SELECT held, any_value(a) AS a FROM s GROUP BY held, i QUALIFY row_number() OVER (PARTITION BY held ORDER BY avg(r2) DESC, i) = 1),
u AS (SELECT held, {_LINE} FROM tr GROUP BY held),
p AS (SELECT y, my + sxy / (sxx + a) * (x - mx) AS p, avg(y) OVER () AS own FROM e JOIN u ON u.held = e.fold JOIN b ON b.held = e.fold)
SELECT 'label' AS target, count(*) AS n, (SELECT median(a) FROM b) AS alpha, round(1 - sum(pow(y - p, 2)) / sum(pow(y - own, 2)), 6) AS r2, round(covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p)), 6) AS pearson,
  round(sqrt(avg(pow(y - p, 2))), 6) AS rmse, 'ok' AS status FROM p"""
O["ridge_loo_1d"] = f"""WITH {_VECTOR}, {_ALPHAS}, t AS (SELECT {_LINE} FROM e)
SELECT a AS alpha, round(avg(pow((y - my - sxy / (sxx + a) * (x - mx)) / (1 - 1.0::DOUBLE / n - pow(x - mx, 2) / (sxx + a)), 2)), 6) AS mean_square FROM e, t, g GROUP BY a"""
_RES = "res AS (SELECT l_returnflag AS model, l_linenumber AS pct, l_orderkey % 3 AS seed, round(avg(l_discount), 9) AS test_r2 FROM lineitem GROUP BY 1, 2, 3)"
O["summary_by_model"] = f"WITH {_RES} SELECT model, pct, count(*) AS n, round(avg(test_r2), 6) AS mean, round(median(test_r2), 6) AS median, round(coalesce(stddev_samp(test_r2), 0), 6) AS std, round(min(test_r2), 6) AS min, round(max(test_r2), 6) AS max FROM res GROUP BY 1, 2"
O["summary_population"] = f"WITH {_RES} SELECT model, count(*) AS n, round(avg(test_r2), 6) AS mean, round(stddev_pop(test_r2), 6) AS std FROM res GROUP BY 1"
O["summary_of_one_group"] = "SELECT 'all' AS key, count(*) AS n, round(avg(l_extendedprice), 2) AS mean, round(median(l_extendedprice), 2) AS median, round(stddev_samp(l_extendedprice), 2) AS std, round(min(l_extendedprice), 2) AS min, round(max(l_extendedprice), 2) AS max FROM lineitem"
O["first_physical_lines"] = f"WITH {_SEQ}, {_WIN}, l AS (SELECT row_number() OVER (ORDER BY doc_id, j) - 1 AS line, seq FROM win) SELECT line, seq FROM l WHERE line < 5000"
O["fasta_records"] = f"WITH {_SEQN} SELECT CAST(doc_id AS VARCHAR) AS chrom, (length(seq) + 999) // 1000 AS n_rows, length(seq) AS n, length(seq) - length(translate(seq, 'GC', '')) AS gc FROM seqs WHERE length(seq) > 0"
O["stateful_windows"] = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS starts, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1, 2 HAVING count(value) > 0 AND time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
O["sql_kmers"] = f"""WITH {_SEQN}, t AS (SELECT doc_id, pos, substr(seq, pos + 1, 4) AS kmer FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 3)) AS pos FROM seqs WHERE length(seq) >= 4))
SELECT doc_id, count(*) AS n, count(DISTINCT kmer) AS n_distinct, CAST(sum(CASE WHEN kmer LIKE '%N%' THEN 3 ELSE 4 + list_sum(list_transform(range(1, 5), lambda i: CAST(pow(4, 4 - i) AS INTEGER) * (strpos('ACGT', substr(kmer, i, 1)) - 1))) END) AS BIGINT) AS ids,
  round(avg(length(regexp_replace(kmer, '[^GC]', '', 'g')) / 4.0::DOUBLE), 6) AS gc, count(*) FILTER (kmer = reverse(translate(kmer, 'ACGT', 'TGCA'))) AS palindromes, CAST(max(pos) AS INTEGER) AS last FROM t GROUP BY doc_id"""
O["summary_ordered"] = f"WITH {_RES}, o(turn, model) AS (VALUES (0, 'R'), (1, 'missing'), (2, 'A'), (3, 'N')) SELECT turn, o.model, CASE WHEN count(test_r2) > 0 THEN count(test_r2) END AS n, round(avg(test_r2), 6) AS mean, round(median(test_r2), 6) AS median, round(stddev_samp(test_r2), 6) AS std, round(min(test_r2), 6) AS min, round(max(test_r2), 6) AS max FROM o LEFT JOIN res ON res.model = o.model GROUP BY 1, 2"
O["best_alpha_first"] = f"WITH {_RES} SELECT model, seed, pct, round(test_r2, 3) AS score FROM res QUALIFY row_number() OVER (PARTITION BY model, seed ORDER BY round(test_r2, 3) DESC, pct) = 1"
O["mean_results"] = f"WITH {_RES}, m AS (SELECT model, pct, round(avg(test_r2), 6) AS mean_r2 FROM res GROUP BY 1, 2) SELECT 'raw' AS given, * FROM m UNION ALL SELECT 'aggregated', * FROM m"
O["union_labelled"] = "SELECT part, count(*) AS n, CAST(sum(key) AS BIGINT) AS total FROM (SELECT n_nationkey AS key, 'nation' AS part FROM nation UNION ALL SELECT r_regionkey, 'region' FROM region UNION ALL SELECT s_suppkey, 'supplier' FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer) GROUP BY part"
O["resume_antijoin"] = "SELECT doc_id FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 <> 0)"
O["resumed_results"] = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 <> 0 THEN 'kept' ELSE 'made' END AS r2 FROM documents"
O["append_metric_leftjoin"] = "SELECT source, count(*) AS n, max(n_chars) FILTER (lang = 'fr') AS metric FROM documents GROUP BY source"
O["grid_crossjoin"] = "SELECT r_name, seed, pct FROM region, (VALUES (0), (1), (2)) s(seed), (VALUES (5), (30), (100)) p(pct)"
O["parse_names"] = "WITH f AS (SELECT replace(p_brand, '#', '_') || '_x.txt' AS file FROM part UNION ALL SELECT r_name || '.txt' FROM region) SELECT file, string_split(file, '_')[1] AS family, coalesce(string_split(replace(file, '.txt', ''), '_')[2], replace(file, '.txt', '')) AS factor, count(*) AS n FROM f GROUP BY file"
O["families"] = "SELECT DISTINCT string_split(replace(p_brand, '#', '_'), '_')[1] AS family FROM part"
O["told_numbers"] = "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 OR value IS NULL THEN 'NA' ELSE printf('%.4f', value) END AS told FROM events"
O["gc_by_document"] = f"WITH {_SEQ} SELECT doc_id, round(length(regexp_replace(seq, '[AT]', '', 'g')) / nullif(length(seq), 0)::DOUBLE, 6) AS gc FROM seqs"
O["kmer_gc_profile"] = f"WITH {_SEQ}, {_TOK}, q AS (SELECT doc_id, pos, length(regexp_replace(kmer, '[AT]', '', 'g')) / 6.0::DOUBLE AS gc FROM tok) SELECT doc_id, count(*) AS n, round(avg(gc), 6) AS mean, round(sum(gc * pos), 4) AS by_place FROM q GROUP BY doc_id"
O["most_tokens"] = f"WITH {_SEQ} SELECT CAST(max(length(seq)) - 5 AS INTEGER) AS n FROM seqs"
_FILE = sorted(features(), key=lambda f: (-f.width, f.index))
_ORDERS = {"file": _FILE, "plain": list(features()), "config": [f for n in ("twistDisp", "wedge", "NPP") for f in features() if f.name == n]}
_LISTED = ", ".join(f"('{o}', {i}, '{f.name}')" for o, fs in _ORDERS.items() for i, f in enumerate(fs))
O["lookup_file_order"] = f"""WITH {_SEQ}, {_LOOK}, {_SEEN}, l(o, turn, feature) AS (VALUES {_LISTED})
SELECT o AS "order", CAST(turn AS INTEGER) AS feature_index, l.feature, CAST(any_value(n) AS INTEGER) AS width, count(*) AS n, round(sum(value), 6) AS total, round(sum(value * seen), 3) AS total_seen
FROM l JOIN look ON look.feature = l.feature JOIN w ON w.word = look.word GROUP BY 1, 2, 3"""
O["weighted_losses"] = "WITH e AS (SELECT event_type, event_id % 4 AS mask, value - 1.5 AS d FROM events) SELECT event_type, round(0.7 * avg(CASE WHEN abs(d) <= 1 THEN d * d / 2 ELSE abs(d) - 0.5 END) FILTER (mask <> 0) + 0.2 * avg(d * d), 6) AS total FROM e GROUP BY 1"
O["losses"] = "WITH e AS (SELECT event_type, event_id % 4 AS mask, value - 1.5 AS d FROM events) SELECT event_type, round(avg(CASE WHEN abs(d) <= 1 THEN d * d / 2 ELSE abs(d) - 0.5 END) FILTER (mask <> 0), 6) AS huber, round(avg(d * d) FILTER (mask <> 0), 6) AS mse, 0.0::DOUBLE AS none FROM e GROUP BY 1"
O["token_cross_entropy"] = "WITH e AS (SELECT label, CASE WHEN vec_id % 6 = 0 THEN label END AS told, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings) SELECT label, round(avg(CASE WHEN told IS NOT NULL THEN ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[told + 1] END), 6) AS loss FROM e GROUP BY 1"
O["running_stats_windows"] = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS starts, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1, 2"
O["merged_batches"] = "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1"


def _attention(masked: bool = False) -> str:
    """The tiny ruled encoder, by hand: one-hot letters, one head of attention, two norms, a layer of two; then means over
    positions, or with masks the cross-entropy of masked tokens, whose letters are zeros."""
    from motifold.plans.queries import PAIRS, TINY, ruled_weights

    shape = PAIRS if masked else TINY
    w = ruled_weights(shape)
    last = 37 - shape.k
    hidden = "masked OR " if masked else ""
    base = lambda i, c: f"CASE WHEN {hidden}false THEN 0 ELSE CASE substr(kmer, {i + 1}, 1) " + " ".join(f"WHEN '{b}' THEN {w['input.weight'][c, 4 * i + k]!r}::DOUBLE" for k, b in enumerate("ACGT")) + " END END"
    place = lambda c: "CASE pos " + " ".join(f"WHEN {p} THEN {w['position'][p, c]!r}::DOUBLE" for p in range(last)) + " END"
    start = ", ".join(f"{' + '.join(base(i, c) for i in range(shape.k))} + {w['input.bias'][c]!r} + {place(c)} AS h{c}" for c in (0, 1))
    line = lambda name, row, a, b: f"({w[name + '.weight'][row, 0]!r}::DOUBLE * {a} + {w[name + '.weight'][row, 1]!r}::DOUBLE * {b} + {w[name + '.bias'][row]!r}::DOUBLE)"
    qkv = ", ".join(f"{line('layer0.qkv', 2 * k + c, 'h0', 'h1')} AS {n}{c}" for k, n in enumerate("qkv") for c in (0, 1))
    norm = lambda a, b, c: f"({c} - ({a} + {b}) / 2) / sqrt(pow(({a} - {b}) / 2, 2) + 1e-5)"
    up = lambda r: f"greatest({line('layer0.up', r, 'n0', 'n1')}, 0)"
    near = "exp((a.q0 * b.k0 + a.q1 * b.k1) / sqrt(2))"
    draw = _draw(12345, "concat_ws('-', doc_id, j)", "pos")
    marks = f"SELECT *, u / 4294967296.0::DOUBLE < 0.15 OR row_number() OVER (PARTITION BY doc_id, j ORDER BY u, pos) = 1 AS masked FROM (SELECT *, {draw} AS u FROM tk0)" if masked else "SELECT *, false AS masked FROM tk0"
    told = f"""SELECT win.doc_id, CAST(win.j AS INTEGER) AS j, round(avg(f0) + 1.3e-7, 5) + 0.0 AS f0, round(avg(f1) + 1.3e-7, 5) + 0.0 AS f1, round(avg({line("target_head", 0, "f0", "f1")}) + 1.3e-7, 5) + 0.0 AS f2, round(avg({line("target_head", 1, "f0", "f1")}) + 1.3e-7, 5) + 0.0 AS f3 FROM win LEFT JOIN f ON f.doc_id = win.doc_id AND f.j = win.j GROUP BY 1, 2"""
    if masked:
        every = ", ".join(line("token_head", r, "f0", "f1") for r in range(shape.tokens))
        code = "4 * (strpos('ACGT', substr(kmer, 1, 1)) - 1) + strpos('ACGT', substr(kmer, 2, 1)) - 1"
        told = f"""SELECT concat_ws('-', win.doc_id, win.j) AS id, CAST(count(l) AS INTEGER) AS n_masked, round(avg(ln(list_sum(list_transform(l, lambda x: exp(x)))) - l[5 + {code}]) + 1.3e-7, 5) AS loss FROM win LEFT JOIN (SELECT *, [{every}] AS l FROM f WHERE masked) f ON f.doc_id = win.doc_id AND f.j = win.j GROUP BY win.doc_id, win.j"""
    return f"""WITH {_SEQ}, {_WIN}, tk0 AS (SELECT doc_id, j, pos, substr(seq, pos + 1, {shape.k}) AS kmer FROM (SELECT doc_id, j, seq, unnest(range(0, length(seq) + 1 - {shape.k})) AS pos FROM win)), tk AS ({marks}),
h AS (SELECT doc_id, j, pos, kmer, masked, {start} FROM tk), q AS (SELECT *, {qkv} FROM h),
att AS (SELECT a.doc_id, a.j, a.pos, any_value(a.kmer) AS kmer, any_value(a.masked) AS masked, any_value(a.h0) AS h0, any_value(a.h1) AS h1, sum({near} * b.v0) / sum({near}) AS m0,
  sum({near} * b.v1) / sum({near}) AS m1 FROM q a JOIN q b ON b.doc_id = a.doc_id AND b.j = a.j GROUP BY 1, 2, 3),
r AS (SELECT *, h0 + {line("layer0.mix", 0, "m0", "m1")} AS r0, h1 + {line("layer0.mix", 1, "m0", "m1")} AS r1 FROM att),
n AS (SELECT *, {norm("r0", "r1", "r0")} AS n0, {norm("r0", "r1", "r1")} AS n1 FROM r), u AS (SELECT *, {up(0)} AS u0, {up(1)} AS u1 FROM n),
d AS (SELECT *, n0 + {line("layer0.down", 0, "u0", "u1")} AS d0, n1 + {line("layer0.down", 1, "u0", "u1")} AS d1 FROM u),
f AS (SELECT doc_id, j, pos, kmer, masked, {norm("d0", "d1", "d0")} AS f0, {norm("d0", "d1", "d1")} AS f1 FROM d)
{told}"""


O["encode_attention"] = _attention().replace("np.float64(", "(")
O["masked_token_loss"] = _attention(True).replace("np.float64(", "(")
O["collated_batches"] = f"""WITH {_SEQN}, {_TOK}, t AS (SELECT doc_id, pos, {_CODE} AS id, {_unit(12345, "doc_id", "pos")} < 0.15 AS hidden FROM tok),
d AS (SELECT doc_id, count(*) AS size, sum(id) AS ids, sum(CASE WHEN hidden THEN id ELSE -100 END) AS labels FROM t GROUP BY doc_id),
p AS (SELECT *, length(bin(size)) - 1 AS e FROM d), b AS (SELECT *, e * 8 + ((size - (1 << e)) * 8) // (1 << e) AS bucket FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {_draw(42, "doc_id")}, doc_id) AS rank, CAST(ceil((1 << e) * (bucket % 8 + 9) / 8.0::DOUBLE) AS BIGINT) - 1 AS most FROM b),
c AS (SELECT *, (rank - 1) // greatest(1, 16384 // most) AS batch FROM r)
SELECT CAST(bucket AS INTEGER) AS bucket, CAST(batch AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS n, CAST(max(size) AS INTEGER) AS longest, CAST(sum(size) AS BIGINT) AS tokens,
CAST(count(*) * max(size) - sum(size) AS BIGINT) AS padding, CAST(sum(ids) AS BIGINT) AS ids, CAST(sum(labels) - 100 * (count(*) * max(size) - sum(size)) AS BIGINT) AS labels FROM c GROUP BY bucket, batch"""
