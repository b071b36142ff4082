"""The same results in SQL over the same tables."""

EMB = "emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::BIGINT AS cluster_id FROM embeddings)"


def _picks(source: str, ratio: float) -> str:
    return (
        f"picks AS (SELECT id FROM {source} ORDER BY md5('42:' || id), id LIMIT "
        f"(SELECT greatest(2, least(CAST(floor(count(*) * {ratio}::DOUBLE / 100) AS BIGINT), count(*) - 1)) FROM {source}))"
    )


EMB_PICKS = _picks("emb", 2.0)


def _grams(radius: int) -> str:
    parts = ["t"]
    for n in range(2, radius + 2):
        run = " || ' ' || ".join(["t[i]"] + [f"t[i + {k}]" for k in range(1, n)])
        parts.append(f"list_transform(range(1, len(t) - {n - 2}), lambda i: {run})")
    return " || ".join(parts)


def _fp(radius: int = 2, n_bits: int = 1024, classes: bool = False) -> str:
    tokens = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"
    if classes:
        tokens = f"list_transform({tokens}, lambda w: regexp_replace(lower(w), '\\d', '#', 'g'))"
    return (
        f"tok AS (SELECT doc_id AS id, lang, {tokens} AS t FROM documents), "
        f"fp AS (SELECT id, ascii(lang) * 256 + ascii(substr(lang, 2, 1)) AS cluster_id, "
        f"list_sort(list_distinct(list_transform({_grams(radius)}, "
        f"lambda g: ('0x' || substr(md5(g), 1, 8))::BIGINT % {n_bits}))) AS bits FROM tok)"
    )


# One BIT value per document: shared bits by AND.
FP_BITS = _fp() + (
    ", bm AS (SELECT f.id, f.cluster_id, f.bits, len(f.bits) AS n, g.m FROM fp f LEFT JOIN "
    "(SELECT id, bitstring_agg(b::INT, 0, 1023) AS m FROM (SELECT id, unnest(bits) AS b FROM fp) GROUP BY id) g USING (id))"
)
SIM = "(CASE WHEN a.n > 0 AND b.n > 0 THEN bit_count(a.m & b.m)::DOUBLE / (a.n + b.n - bit_count(a.m & b.m)) ELSE 0::DOUBLE END)"
DOC_PAIRS = f"{FP_BITS}, sims AS (SELECT a.id AS a, b.id AS b, {SIM} AS sim, a.cluster_id AS ca, b.cluster_id AS cb FROM bm a, bm b)"
# Distinct fingerprints with their copies; empty ones stay apart.
DOC_GROUPS = (
    f"{FP_BITS}, grp AS (SELECT min(id) AS id, count(*) AS copies, any_value(m) AS m, any_value(n) AS n FROM bm "
    "GROUP BY bits, CASE WHEN n = 0 THEN id END)"
)
DOC_PICKS = _picks("bm", 2.0)

EMB_DIST = f"{EMB}, {EMB_PICKS}, d AS (SELECT e.id, arg_min(p.id, (list_distance(e.v, q.v), p.id)) AS ref_id, min(list_distance(e.v, q.v)) AS dist FROM emb e, picks p JOIN emb q ON q.id = p.id GROUP BY e.id)"
DOC_DIST = f"{FP_BITS}, {DOC_PICKS}, d AS (SELECT a.id, arg_min(b.id, (1 - {SIM}, b.id)) AS ref_id, min(1 - {SIM}) AS dist FROM bm a, picks p JOIN bm b ON b.id = p.id GROUP BY a.id)"


def _r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _coverage(dist: str, threshold: float) -> str:
    return f"""WITH {dist}, s AS (SELECT list_sort(list(dist)) AS l, count(*) AS n, avg(dist) AS mean, max(dist) AS top,
        avg(CASE WHEN dist <= {threshold} THEN 1::DOUBLE ELSE 0 END) AS ratio, quantile_cont(dist, 0.5) AS median FROM d)
        SELECT round(ratio, 6) AS coverage_ratio, round(mean, 6) AS mean_distance, round(top, 6) AS max_distance,
        round(median, 6) AS median_distance, round(l[floor(0.9::DOUBLE * n)::BIGINT + 1], 6) AS radius_90,
        round(l[floor(0.95::DOUBLE * n)::BIGINT + 1], 6) AS radius_95,
        round(ratio * CASE WHEN top > 0 THEN 1 - mean / top ELSE 1 END, 6) AS hybrid_score FROM s"""


def _maxmin(items: str, distance: str, ratio: float, key: str) -> str:
    """Farthest-first from the lowest id: the state holds every row's distance to the nearest pick."""
    return f"""{items}, k AS (SELECT greatest(2, least(CAST(floor(count(*) * {ratio}::DOUBLE / 100) AS BIGINT), count(*) - 1)) AS k FROM {key}),
        state AS (SELECT 0::BIGINT AS step, a.id, {distance} AS far, b.id AS pick, NULL::DOUBLE AS gap
            FROM {key} a, {key} b WHERE b.id = (SELECT min(id) FROM {key})
          UNION ALL
          SELECT s.step + 1, s.id, CASE WHEN s.id = s.nxt THEN -1::DOUBLE ELSE least(s.far, {distance}) END, s.nxt, s.gap
            FROM (SELECT step, id, CASE WHEN id = pick THEN -1::DOUBLE ELSE far END AS far,
                    first_value(id) OVER (ORDER BY CASE WHEN id = pick THEN -1::DOUBLE ELSE far END DESC, id) AS nxt,
                    max(CASE WHEN id = pick THEN -1::DOUBLE ELSE far END) OVER () AS gap FROM state) s
            JOIN {key} a ON a.id = s.id JOIN {key} b ON b.id = s.nxt, k WHERE s.step + 1 < k.k),
        mm AS (SELECT DISTINCT pick AS id, step AS pick_order, gap AS pick_dist FROM state)"""


def _butina(edges: str) -> str:
    """The sequential rule: ``edges`` gives all ordered close pairs ``(a, b)`` and all rows ``nodes(id)``."""
    return f"""{edges},
        counted AS (SELECT n.id, count(e.b) AS c, coalesce(list(e.b) FILTER (e.b IS NOT NULL), []) AS near FROM nodes n LEFT JOIN close e ON e.a = n.id GROUP BY n.id),
        ranked AS (SELECT *, row_number() OVER (ORDER BY c DESC, id DESC) AS rk FROM counted),
        walk AS (SELECT 0::BIGINT AS rk, []::BIGINT[] AS centers
          UNION ALL
          SELECT r.rk, CASE WHEN list_has_any(r.near, w.centers) THEN w.centers ELSE list_append(w.centers, r.id) END
            FROM walk w JOIN ranked r ON r.rk = w.rk + 1),
        done AS (SELECT centers FROM walk ORDER BY rk DESC LIMIT 1),
        cen AS (SELECT unnest(centers) AS center, generate_subscripts(centers, 1) - 1 AS cluster_id FROM done),
        lab AS (SELECT r.id, min(c.cluster_id)::BIGINT AS cluster_id, bool_or(c.center = r.id) AS is_center FROM ranked r
            JOIN cen c ON c.center = r.id OR (list_contains(r.near, c.center) AND NOT EXISTS (SELECT 1 FROM cen x WHERE x.center = r.id)) GROUP BY r.id)"""


EMB_EDGES = f"{EMB}, nodes AS (SELECT id FROM emb), close AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM emb a JOIN emb b ON a.id <> b.id AND list_distance(a.v, b.v) <= 1.15)"
DOC_EDGES = f"{DOC_PAIRS}, nodes AS (SELECT id FROM bm), close AS MATERIALIZED (SELECT a, b FROM sims WHERE a <> b AND 1 - sim <= 0.4::DOUBLE)"



def _linked(edges: str) -> str:
    """Links of every row and the least id that it reaches by them."""
    return f"""WITH RECURSIVE {edges},
        reach AS (SELECT id, id AS root FROM nodes UNION SELECT e.a, r.root FROM reach r JOIN close e ON e.b = r.id AND r.root < e.a),
        least AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
        SELECT l.id, (SELECT count(*) FROM close e WHERE e.a = l.id) AS n_links, l.root AS component_id FROM least l"""


MEDOID = """sums AS (SELECT {c} AS cluster_id, a AS id, sum(sim) FILTER (a <> b) / nullif(count(*) FILTER (a <> b), 0) AS score FROM {t} GROUP BY ALL),
    best AS (SELECT cluster_id, id, score, row_number() OVER (PARTITION BY cluster_id ORDER BY round(coalesce(score, 0), 9) DESC, id) AS r FROM sums)"""

MEANS = "parts AS (SELECT cluster_id, pos, avg(x) AS x FROM (SELECT cluster_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb) GROUP BY ALL), means AS (SELECT cluster_id, list(x ORDER BY pos) AS m FROM parts GROUP BY cluster_id)"
FIRSTS = "firsts AS (SELECT cluster_id, min(id) AS id FROM {t} GROUP BY cluster_id)"

SILHOUETTE = f"""WITH {EMB}, sums AS (SELECT a.id, a.cluster_id AS own, b.cluster_id AS other, sum(list_distance(a.v, b.v)) AS t, count(*) AS n FROM emb a, emb b GROUP BY ALL),
    ab AS (SELECT id, max(t / greatest(n - 1, 1)) FILTER (own = other) AS a, max(n) FILTER (own = other) AS n, min(t / n) FILTER (own <> other) AS b FROM sums GROUP BY id)
    SELECT avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette_score FROM ab"""
DB = f"""WITH {EMB}, {MEANS}, sp AS (SELECT m.cluster_id, any_value(m.m) AS m, avg(list_distance(e.v, m.m)) AS s FROM emb e JOIN means m USING (cluster_id) GROUP BY 1),
    r AS (SELECT a.cluster_id, max((a.s + b.s) / list_distance(a.m, b.m)) AS r FROM sp a JOIN sp b ON a.cluster_id <> b.cluster_id GROUP BY 1)
    SELECT avg(r) AS davies_bouldin_score FROM r"""
CH = f"""WITH {EMB}, {MEANS}, o AS (SELECT list(x ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb) GROUP BY pos)),
    w AS (SELECT sum(list_distance(e.v, m.m) ** 2) AS w, sum(list_distance(m.m, o.m) ** 2) AS b, count(*) AS n, count(DISTINCT cluster_id) AS k FROM emb e JOIN means m USING (cluster_id), o)
    SELECT b * (n - k) / (w * (k - 1)) AS calinski_harabasz_score FROM w"""
SIZES = "SELECT count(*) AS n_clusters, avg(n) AS avg_cluster_size, min(n)::DOUBLE AS min_cluster_size, max(n)::DOUBLE AS max_cluster_size, stddev_pop(n) AS std_cluster_size FROM (SELECT label, count(*) AS n FROM embeddings WHERE label >= 0 GROUP BY label)"
INTRA = f"WITH {EMB} SELECT avg(1 - list_distance(a.v, b.v)) AS avg_intra_cluster_similarity FROM emb a JOIN emb b ON a.cluster_id = b.cluster_id AND a.id < b.id"


def _scaled(shift: str, scale: str) -> str:
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = ", ".join(
        f"round((t.{c} - s.{c}_s) / CASE WHEN s.{c}_w > 0 THEN s.{c}_w ELSE 1 END, 6) AS f{k}" for k, c in enumerate(cols)
    )
    stats = ", ".join(f"{shift.format(c=c)} AS {c}_s, {scale.format(c=c)} AS {c}_w" for c in cols)
    return f"WITH s AS (SELECT {stats} FROM lineitem) SELECT l_orderkey * 10 + l_linenumber AS id, {out} FROM lineitem t, s"


MASS = "list_sum(list_transform(range(1, p_size + 1), lambda i: CASE WHEN i % 3 = 0 THEN 15.99491461957::DOUBLE WHEN i % 3 = 1 THEN 12.0::DOUBLE ELSE 34.968852682::DOUBLE END))"

HIST = """b AS (SELECT {lo} AS lo, {hi} AS hi, count(*) AS n FROM {t}), h AS (SELECT least(floor(({x} - lo) / ((hi - lo) / {bins})), {bins} - 1)::BIGINT AS bin, count(*) AS n FROM {t}, b GROUP BY 1)
    SELECT g.bin, round(lo + g.bin * ((hi - lo) / {bins}), 6) AS lower, round(lo + (g.bin + 1) * ((hi - lo) / {bins}), 6) AS upper, coalesce(h.n, 0) AS n,
    round(coalesce(h.n, 0) / (b.n * ((hi - lo) / {bins})), {digits}) AS density FROM (SELECT unnest(range({bins})) AS bin) g LEFT JOIN h USING (bin), b"""

STREAM = f"WITH {EMB}, {FIRSTS.format(t='emb')}, c AS (SELECT f.cluster_id, e.v FROM firsts f JOIN emb e USING (id)), d AS (SELECT e.id, arg_min(c.cluster_id, (list_distance(e.v, c.v), c.cluster_id)) AS cluster_id, min(list_distance(e.v, c.v)) AS dist FROM emb e, c GROUP BY e.id) SELECT id, cluster_id, round(dist, 6) AS dist, dist > 1.25 AS is_far FROM d"

BITS_OF = "list_filter(list_transform({v}, lambda x, i: CASE WHEN x > 0 THEN i END), lambda i: i IS NOT NULL)"

ORACLE = {
    "filter_range": "SELECT p_partkey, p_retailprice, p_size FROM part WHERE p_retailprice BETWEEN 905 AND 980 AND p_size <= 30",
    "flag_valid": "SELECT count(*) AS total, count(*) FILTER (p_size >= 10 AND isfinite(p_retailprice)) AS valid FROM part",
    "subset_semi": f"WITH {EMB}, {EMB_PICKS} SELECT id, cluster_id FROM emb WHERE id IN (SELECT id FROM picks)",
    "normalise_text": """WITH p AS (SELECT doc_id, string_split(regexp_replace(trim(text), '\\[\\d+([A-Za-z])', '[\\1', 'g'), '.') AS parts FROM documents),
        l AS (SELECT doc_id, list_filter(parts, lambda s: length(s) = list_max(list_transform(parts, lambda q: length(q))))[1] AS s FROM p)
        SELECT doc_id, length(s) AS n_chars_longest, md5(s) AS digest FROM l""",
    "fingerprint_bits": f"WITH {_fp()} SELECT id, len(bits) AS n_on, array_to_string(bits, ',') AS bits FROM fp",
    "fingerprint_classes": f"WITH {_fp(1, 512, True)} SELECT id, len(bits) AS n_on, array_to_string(bits, ',') AS bits FROM fp",
    "fingerprint_packed": f"""WITH {_fp()}, w AS (SELECT id, bits, unnest(range(16)) AS pos FROM fp)
        SELECT id, pos, list_sum(list_transform(list_filter(bits, lambda b: b // 64 = pos),
            lambda b: CASE WHEN b % 64 = 63 THEN (-9223372036854775808)::HUGEINT ELSE (1::HUGEINT << (b % 64)::INT) END) || [0::HUGEINT])::BIGINT AS word FROM w""",
    "fingerprint_dense": f"WITH {_fp()} SELECT id, 1024::BIGINT AS width, len(bits)::DOUBLE AS ones, coalesce(list_sum(bits), 0)::DOUBLE AS position_sum FROM fp",
    "text_counts": "SELECT doc_id, " + ", ".join(
        f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in {"words": "[\\p{L}\\p{N}_]+", "digits": "\\d", "capitals": "\\p{Lu}", "stops": "[.!?]"}.items()
    ) + " FROM documents",
    "array_stats": f"WITH {EMB} SELECT id, round(list_avg(v), 6) AS v_mean, round(list_stddev_pop(v), 6) AS v_std, round(list_min(v), 6) AS v_min, round(list_max(v), 6) AS v_max FROM emb",
    "point_shape": """WITH p AS (SELECT l_suppkey AS id, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem),
        c AS (SELECT id, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM p GROUP BY id),
        q AS (SELECT *, (a + b + c) / 3 AS m, sqrt(((a - (a+b+c)/3)**2 + (b - (a+b+c)/3)**2 + (c - (a+b+c)/3)**2 + 2 * (d*d + e*e + f*f)) / 6) AS s FROM c),
        t AS (SELECT id, m, s, acos(greatest(-1, least(1, ((a-m)*((b-m)*(c-m) - f*f) - d*(d*(c-m) - f*e) + e*(d*f - (b-m)*e)) / (2 * s**3)))) / 3 AS g FROM q),
        k AS (SELECT id, m + 2*s*cos(g + 2*pi()/3) AS m1, m + 2*s*cos(g) AS m3, 3*m - (m + 2*s*cos(g)) - (m + 2*s*cos(g + 2*pi()/3)) AS m2 FROM t)
        SELECT id, round(m1, 6) AS moment_1, round(m2, 6) AS moment_2, round(m3, 6) AS moment_3,
        CASE WHEN m1 > 0 AND m2 > 0 AND m3 > 0 THEN round(m1 / m3, 6) END AS sphericity,
        CASE WHEN m1 > 0 AND m2 > 0 AND m3 > 0 THEN round((m3 - (m1 + m2) / 2) / m3, 6) END AS asphericity FROM k""",
    "combine_blocks": f"""WITH {EMB}, f AS (SELECT id, CASE WHEN cluster_id <> 3 THEN v ELSE list_transform(range(64), lambda i: 0::DOUBLE) END
            || [cluster_id::DOUBLE, 0::DOUBLE] || [list_avg(v), list_stddev_pop(v), list_min(v), list_max(v)] AS w FROM emb)
        SELECT id, generate_subscripts(w, 1) - 1 AS pos, round(unnest(w), 6) AS value FROM f""",
    "featurize_rows": """SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN length(replace(p_name, ' ', '')) ELSE -1 END AS letters,
        CASE WHEN p_size % 7 <> 0 THEN round(length(p_name)::DOUBLE / p_size, 6) END AS ratio, p_size % 7 <> 0 AS is_valid FROM part""",
    "pairs_tanimoto_within": _linked(DOC_EDGES),
    "pairs_euclid_within": _linked(EMB_EDGES),
    "pairs_cosine_within": _linked(f"{EMB}, nodes AS (SELECT id FROM emb), close AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM emb a JOIN emb b ON a.id <> b.id AND 1 - list_cosine_similarity(a.v, b.v) <= 0.7)"),
    "neighbour_counts": f"WITH {DOC_PAIRS} SELECT a AS id, count(*) FILTER (a <> b AND 1 - sim <= 0.4::DOUBLE) AS n_neighbours FROM sims GROUP BY a",
    "nearest_euclid": f"WITH {EMB_DIST} SELECT id, ref_id, round(dist, 6) AS dist FROM d",
    "nearest_euclid_partitioned": f"WITH {EMB_DIST} SELECT id, ref_id, round(dist, 6) AS dist FROM d",
    "nearest_tanimoto": f"WITH {DOC_DIST} SELECT id, ref_id, round(dist, 6) AS dist FROM d",
    "k_nearest": f"""WITH {EMB}, r AS (SELECT a.id, b.id AS other, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM emb a JOIN emb b ON a.id <> b.id)
        SELECT id, other, rank, round(dist, 6) AS dist FROM r WHERE rank <= 5""",
    "nearest_summary": f"WITH {EMB_DIST} SELECT round(avg(dist), 6) AS mean_distance, round(max(dist), 6) AS max_distance, round(quantile_cont(dist, 0.5), 6) AS median_distance FROM d",
    "reference_space": f"WITH {FP_BITS}, {FIRSTS.format(t='bm')} SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY b.id) - 1 AS pos, round({SIM}, 6) AS value FROM bm a, firsts f JOIN bm b ON b.id = f.id",
    "reference_space_cosine": f"WITH {EMB}, {FIRSTS.format(t='emb')} SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY b.id) - 1 AS pos, round(list_cosine_similarity(a.v, b.v), 6) AS value FROM emb a, firsts f JOIN emb b ON b.id = f.id",
    "reference_space_rescaled": f"WITH {EMB}, {FIRSTS.format(t='emb')}, d AS (SELECT a.id, b.id AS ref, list_distance(a.v, b.v) AS d FROM emb a, firsts f JOIN emb b ON b.id = f.id) SELECT id, row_number() OVER (PARTITION BY id ORDER BY ref) - 1 AS pos, round(1 - d / max(d) OVER (), 6) AS value FROM d",
    "sql_metrics": f"""WITH {EMB}, {FIRSTS.format(t='emb')}, b AS (SELECT e.id, e.v, q.v AS f, {BITS_OF.format(v='e.v')} AS s, {BITS_OF.format(v='q.v')} AS t FROM emb e JOIN firsts USING (cluster_id) JOIN emb q ON q.id = firsts.id)
        SELECT id, round(list_distance(v, f), 6) AS euclid, round(1 - list_cosine_similarity(v, f), 6) AS cosine, round(1 - len(list_intersect(s, t))::DOUBLE / len(list_distinct(s || t)), 6) AS tanimoto FROM b""",
    "scale_standard": _scaled("avg({c})", "stddev_pop({c})"),
    "scale_minmax": _scaled("min({c})", "max({c}) - min({c})"),
    "scale_robust": _scaled("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "butina_euclid": f"WITH RECURSIVE {_butina(EMB_EDGES)} SELECT id, cluster_id, is_center FROM lab",
    "butina_tanimoto": f"WITH RECURSIVE {_butina(DOC_EDGES)} SELECT id, cluster_id, is_center FROM lab",
    "assign_label_centers": f"WITH {EMB}, {MEANS}, d AS (SELECT e.id, arg_min(m.cluster_id, (list_distance(e.v, m.m), m.cluster_id)) AS cluster_id, min(list_distance(e.v, m.m)) AS dist FROM emb e, means m GROUP BY e.id) SELECT id, cluster_id, round(dist, 6) AS dist FROM d",
    "maxmin_exact": f"WITH RECURSIVE {_maxmin(EMB, 'list_distance(a.v, b.v)', 2.0, 'emb')} SELECT id, pick_order, round(pick_dist, 6) AS pick_dist FROM mm",
    "maxmin_tanimoto": f"WITH RECURSIVE {_maxmin(FP_BITS, f'1 - {SIM}', 1.0, 'bm')} SELECT id, pick_order, round(pick_dist, 6) AS pick_dist FROM mm",
    "reps_medoid": f"WITH {DOC_PAIRS}, same AS (SELECT * FROM sims WHERE ca = cb), {MEDOID.format(c='ca', t='same')} SELECT cluster_id, id, round(score, 6) AS score FROM best WHERE r = 1",
    "reps_first": f"WITH {EMB} SELECT cluster_id, min(id) AS id FROM emb GROUP BY cluster_id",
    "reps_random": f"WITH {EMB} SELECT cluster_id, arg_min(id, (md5('42:' || id), id)) AS id FROM emb GROUP BY cluster_id",
    "reps_nearest_center": f"""WITH {EMB}, {FIRSTS.format(t='emb')}, d AS (SELECT e.cluster_id, e.id, list_distance(e.v, q.v) AS dist FROM emb e JOIN firsts f USING (cluster_id) JOIN emb q ON q.id = f.id WHERE e.id <> f.id)
        SELECT cluster_id, arg_min(id, (dist, id)) AS id, round(min(dist), 6) AS dist FROM d GROUP BY cluster_id""",
    "reps_nearest_mean": f"WITH {EMB}, {MEANS}, d AS (SELECT e.cluster_id, e.id, list_distance(e.v, m.m) AS dist FROM emb e JOIN means m USING (cluster_id)) SELECT cluster_id, arg_min(id, (dist, id)) AS id, round(min(dist), 6) AS dist FROM d GROUP BY cluster_id",
    "labels_from_picks": f"WITH RECURSIVE {_maxmin(EMB, 'list_distance(a.v, b.v)', 2.0, 'emb')} SELECT e.id, coalesce(m.pick_order, -1) AS label FROM emb e LEFT JOIN mm m USING (id)",
    "cluster_lists": f"WITH {EMB} SELECT cluster_id, 0::BIGINT AS part, array_to_string(list(id ORDER BY id), ',') AS members FROM emb GROUP BY cluster_id",
    "select_by_maxmin": f"WITH RECURSIVE {_maxmin(EMB, 'list_distance(a.v, b.v)', 2.0, 'emb')} SELECT id FROM mm",
    "select_by_butina": f"WITH RECURSIVE {_butina(DOC_EDGES)}, same AS (SELECT s.a, s.b, s.sim, x.cluster_id AS c FROM sims s JOIN lab x ON x.id = s.a JOIN lab y ON y.id = s.b AND x.cluster_id = y.cluster_id), {MEDOID.format(c='c', t='same')} SELECT id FROM best WHERE r = 1",
    "cluster_status": "SELECT count(*) AS rows, greatest(2, least(CAST(floor(count(*) * 2::DOUBLE / 100) AS BIGINT), count(*) - 1)) AS picked, 'success' AS good_status, 'error' AS bad_status FROM embeddings",
    "silhouette": f"SELECT round(silhouette_score, 6) AS silhouette_score FROM ({SILHOUETTE})",
    "davies_bouldin": f"SELECT round(davies_bouldin_score, 6) AS davies_bouldin_score FROM ({DB})",
    "calinski_harabasz": f"SELECT round(calinski_harabasz_score, 6) AS calinski_harabasz_score FROM ({CH})",
    "cluster_sizes": f"SELECT n_clusters, {_r6('avg_cluster_size', 'min_cluster_size', 'max_cluster_size', 'std_cluster_size')} FROM ({SIZES})",
    "inertia": f"WITH {EMB}, {MEANS} SELECT round(sum(list_distance(e.v, m.m) ** 2), 6) AS inertia FROM emb e JOIN means m USING (cluster_id)",
    "intra_similarity": f"SELECT round(avg_intra_cluster_similarity, 6) AS avg_intra_cluster_similarity FROM ({INTRA})",
    "intra_similarity_tanimoto": f"WITH {DOC_PAIRS} SELECT round(avg(sim), 6) AS avg_intra_cluster_similarity FROM sims WHERE a < b AND ca = cb",
    "quality_report": f"""SELECT metric, round(value, 6) AS value FROM (
        SELECT 'silhouette_score' AS metric, silhouette_score AS value FROM ({SILHOUETTE}) UNION ALL SELECT 'davies_bouldin_score', davies_bouldin_score FROM ({DB})
        UNION ALL SELECT 'calinski_harabasz_score', calinski_harabasz_score FROM ({CH}) UNION ALL SELECT 'avg_intra_cluster_similarity', avg_intra_cluster_similarity FROM ({INTRA})
        UNION ALL SELECT 'n_clusters', n_clusters::DOUBLE FROM ({SIZES}) UNION ALL SELECT 'avg_cluster_size', avg_cluster_size FROM ({SIZES})
        UNION ALL SELECT 'min_cluster_size', min_cluster_size FROM ({SIZES}) UNION ALL SELECT 'max_cluster_size', max_cluster_size FROM ({SIZES})
        UNION ALL SELECT 'std_cluster_size', std_cluster_size FROM ({SIZES}))""",
    "selection_spread": f"WITH {EMB_DIST} SELECT round((SELECT count(*) FROM picks)::DOUBLE / count(*), 6) AS selected_ratio, round(avg(dist), 6) AS avg_min_distance, round(max(dist), 6) AS max_min_distance, round(stddev_pop(dist), 6) AS std_min_distance FROM d",
    "coverage_metrics": _coverage(EMB_DIST, 1.25),
    "coverage_refined": _coverage(EMB_DIST, 1.25),
    "coverage_tanimoto": _coverage(DOC_DIST, 0.4),
    "property_compare": f"""WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS p_size, p_retailprice FROM part), {_picks('p', 2.0)},
        l AS (SELECT 'library' AS source, * FROM p UNION ALL SELECT 'subset', * FROM p WHERE id IN (SELECT id FROM picks))
        SELECT 'p_size' AS property, source, count(*) AS n, round(avg(p_size), 6) AS mean, round(stddev_pop(p_size), 6) AS std FROM l GROUP BY source
        UNION ALL SELECT 'p_retailprice', source, count(*), round(avg(p_retailprice), 6), round(stddev_pop(p_retailprice), 6) FROM l GROUP BY source""",
    "property_compare_quality": """SELECT 'n_chars' AS property, source, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std FROM (
        SELECT 'library' AS source, n_chars FROM documents UNION ALL SELECT 'subset', n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) GROUP BY source""",
    "histogram_table": "WITH " + HIST.format(lo="min(l_extendedprice)", hi="max(l_extendedprice)", t="lineitem", x="l_extendedprice", bins=40, digits=12),
    "kde_table": """WITH s AS (SELECT count(*) AS n, stddev_samp(l_quantity) * count(*) ** (-0.2::DOUBLE) AS h, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
        g AS (SELECT i AS point, lo - 3 * h + (hi - lo + 6 * h) * i / 31 AS x, h, n FROM s, (SELECT unnest(range(32)) AS i)),
        v AS (SELECT l_quantity AS q, count(*) AS c FROM lineitem GROUP BY 1)
        SELECT point, round(any_value(x), 6) AS x, round(sum(c * exp(-0.5 * ((q - x) / h) ** 2)) / any_value(n * h * sqrt(2 * pi())), 9) AS density FROM g, v GROUP BY point""",
    "similarity_stats": f"WITH {DOC_PAIRS} SELECT count(*) AS pairs, round(avg(sim), 6) AS mean, round(quantile_cont(sim, 0.5), 6) AS median, round(stddev_pop(sim), 6) AS std FROM sims WHERE a < b",
    "similarity_long": f"WITH {FP_BITS}, {FIRSTS.format(t='bm')} SELECT a.id AS id_a, b.id AS id_b, round({SIM}, 6) AS similarity FROM bm a JOIN firsts f ON f.id = a.id, bm b JOIN firsts g ON g.id = b.id",
    "run_summary": f"WITH {EMB}, {EMB_PICKS} SELECT count(*) AS records, count(*) AS valid, (SELECT count(*) FROM picks) AS representatives, round(100 * (SELECT count(*) FROM picks)::DOUBLE / count(*), 6) AS subset_percent FROM emb",
    "sample_rows": f"WITH {EMB}, {EMB_PICKS} SELECT id FROM picks",
    "validation_report": f"WITH {EMB_DIST}, " + HIST.format(lo="min(dist)", hi="max(dist)", t="d", x="dist", bins=20, digits=6),
    "library_csv": "SELECT p_type AS SMILES, p_name AS Name, p_retailprice AS MolWeight FROM part WHERE p_retailprice BETWEEN 950 AND 1200",
    "subset_sink": f"WITH p AS (SELECT p_partkey AS id, p_name, p_size FROM part), {_picks('p', 2.0)} SELECT id, p_name, p_size FROM p WHERE id IN (SELECT id FROM picks)",
    "metrics_sink": f"""SELECT metric, round(value, 6) AS value FROM (SELECT 'n_clusters' AS metric, n_clusters::DOUBLE AS value FROM ({SIZES}) UNION ALL SELECT 'avg_cluster_size', avg_cluster_size FROM ({SIZES})
        UNION ALL SELECT 'min_cluster_size', min_cluster_size FROM ({SIZES}) UNION ALL SELECT 'max_cluster_size', max_cluster_size FROM ({SIZES}) UNION ALL SELECT 'std_cluster_size', std_cluster_size FROM ({SIZES}))""",
    "stage_round_trip": "SELECT label::BIGINT AS cluster_id, count(*) AS n, true AS absent_is_none FROM embeddings GROUP BY label",
    "sdf_round_trip": f"WITH r AS (SELECT CASE WHEN p_type = 'LARGE' THEN '' ELSE p_name END AS name, round({MASS}, 2) AS w FROM part WHERE p_type <> 'SMALL') SELECT name, count(*) AS n, round(sum(w), 4) AS weight FROM r GROUP BY name",
    "conversion_report": "SELECT count(*) AS total, count(*) FILTER (p_type <> 'SMALL') AS processed, count(*) FILTER (p_type = 'SMALL') AS failed, count(*) FILTER (p_type = 'LARGE') AS empty_names FROM part",
    "assign_stream": STREAM,
    "assign_stream_batches": STREAM,
    "reduce_stream": "SELECT unnest(range(5)) AS pos, count(*) AS n, 0::DOUBLE AS difference FROM embeddings",
    "flagship": _coverage(
        f"{_maxmin(EMB, 'list_distance(a.v, b.v)', 1.0, 'emb')}, d AS (SELECT e.id, min(list_distance(e.v, q.v)) AS dist FROM emb e, mm JOIN emb q ON q.id = mm.id GROUP BY e.id)", 1.25
    ).replace("WITH ", "WITH RECURSIVE ", 1),
}


PART_LIBRARY = """p AS (SELECT p_partkey AS id, p_name, p_retailprice, p_size FROM part WHERE p_retailprice BETWEEN 920 AND 1500),
    sc AS (SELECT avg(p_retailprice) AS mw, stddev_pop(p_retailprice) AS sw, avg(p_size) AS ms, stddev_pop(p_size) AS ss FROM p),
    e AS (SELECT id, [(p_retailprice - mw) / sw, (p_size - ms) / ss] AS v FROM p, sc)"""


_BY_LABEL = f"{FIRSTS.format(t='emb')}, c0 AS MATERIALIZED (SELECT f.cluster_id, e.v AS c FROM firsts f JOIN emb e USING (id))"


def _by_order(k: str) -> str:
    """The first ``k`` rows in seeded order as centres 0, 1, ..."""
    return f"c0 AS MATERIALIZED (SELECT r - 1 AS cluster_id, v AS c FROM (SELECT v, row_number() OVER (ORDER BY md5('42:' || id), id) AS r FROM emb) WHERE r <= {k})"


def _lloyd(rounds: int, start: str, then: str = "") -> str:
    """Assignment after so many rounds from the centres ``c0``; ``then`` goes on from the last rows ``a`` and centres ``c``."""
    steps = [f"{EMB}, {start}"]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT e.id, arg_min(c.cluster_id, (list_distance(e.v, c.c), c.cluster_id)) AS g FROM emb e, c{k} c GROUP BY e.id)")
        steps.append(
            f"c{k + 1} AS MATERIALIZED (SELECT g AS cluster_id, list(m ORDER BY i) AS c FROM (SELECT g, i, avg(x) AS m FROM (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb) "
            f"JOIN a{k} USING (id) GROUP BY g, i) GROUP BY g UNION ALL SELECT cluster_id, c FROM c{k} WHERE cluster_id NOT IN (SELECT g FROM a{k}))"
        )
    steps.append(f"a AS (SELECT id, g AS cluster_id FROM a{rounds}), c AS (SELECT * FROM c{rounds})")
    return f"WITH {', '.join(steps)} " + (then or "SELECT id, cluster_id FROM a")


ORACLE |= {
    "kmeans_from_start": _lloyd(4, _BY_LABEL),
    "kmeans_sizes": _lloyd(4, _by_order("10"), "SELECT cluster_id, count(*) AS n FROM a GROUP BY cluster_id"),
    "select_by_kmeans": _lloyd(
        4, _by_order("(SELECT greatest(2, least(CAST(floor(count(*) * 2.0::DOUBLE / 100) AS BIGINT), count(*) - 1)) FROM emb)"),
        "SELECT arg_min(e.id, (list_distance(e.v, c.c), e.id)) AS id FROM a JOIN emb e USING (id) JOIN c ON c.cluster_id = a.cluster_id GROUP BY a.cluster_id",
    ),
    "kmeans_minibatch": "SELECT count(*) AS n, 10::BIGINT AS labels, count(*) AS nearest FROM embeddings",
    "pca_full_rank": f"""WITH {EMB}, m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x) AS a FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb) GROUP BY i))
        SELECT id, round(list_distance(v, m), 6) AS norm FROM emb, m""",
    "pipeline_end_to_end": f"""WITH RECURSIVE {_maxmin(PART_LIBRARY, 'list_distance(a.v, b.v)', 1.0, 'e')},
        d AS (SELECT e.id, min(list_distance(e.v, q.v)) AS dist FROM e, mm JOIN e q ON q.id = mm.id GROUP BY e.id)
        SELECT id, p_name AS Name, p_retailprice AS MolWeight, p_size, round((SELECT avg(dist) FROM d), 6) AS mean_distance, round((SELECT max(dist) FROM d), 6) AS max_distance
        FROM p WHERE id IN (SELECT id FROM mm)""",
    "subset_sink_sdf": f"""WITH p AS (SELECT p_partkey AS id, * FROM part), {_picks('p', 2.0)}
        SELECT CASE WHEN p_type = 'LARGE' THEN '' ELSE p_name END AS name, round({MASS}, 2) AS mol_weight FROM p WHERE p_type <> 'SMALL' AND id IN (SELECT id FROM picks)""",
    "validation_report_full": f"""SELECT 'coverage' AS section, name, value FROM (UNPIVOT ({_coverage(EMB_DIST, 1.25)}) ON COLUMNS(*) INTO NAME name VALUE value)
        UNION ALL SELECT 'properties', 'cluster_id library', round(avg(label), 6) FROM embeddings
        UNION ALL SELECT 'properties', 'cluster_id subset', v FROM (WITH {EMB}, {EMB_PICKS} SELECT round(avg(cluster_id), 6) AS v FROM emb WHERE id IN (SELECT id FROM picks))
        UNION ALL SELECT 'nearest', 'rows', count(*)::DOUBLE FROM embeddings
        UNION ALL SELECT 'histogram', bin::VARCHAR, n::DOUBLE FROM ({ORACLE['validation_report']})""",
    "scale_robust_counted": ORACLE["scale_robust"],
    "pca_range_full": f"""WITH {EMB}, m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x) AS a FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb) GROUP BY i))
        SELECT id, round(list_distance(v, m), 6) AS norm FROM emb, m""",
    "sdf_data_source": ORACLE["sdf_round_trip"],
    "sdf_stream": ORACLE["conversion_report"],
}
ORACLE |= {
    f"{name}_blocked": ORACLE[name]
    for name in (
        "pairs_euclid_within", "pairs_tanimoto_within", "neighbour_counts", "nearest_euclid", "nearest_tanimoto", "k_nearest", "butina_euclid",
        "reps_medoid", "silhouette", "similarity_stats", "sample_rows",
    )
}
