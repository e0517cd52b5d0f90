"""The drift-aware ensemble of naive Bayes learners as DuckDB SQL, unrolled over slots: what the queries on it are compared with."""

from __future__ import annotations


def ensemble_sql(features: list[str], name: str = "nse", slots: int = 11) -> str:
    """Tables <name>_weight (slot, created, weight), <name>_error (slot, n_members, n, n_wrong) and <name>_judged (slot, object_id,
    created, weight, margin: each member's log-odds for a row of the slot, by the weights before it), from d (slot, object_id, y, ...).

    features: expressions over d; null is a missing value, which says nothing and counts for nothing.
    """
    n, out = name, []

    def add(table: str, sql: str) -> None:
        out.append(f"{n}_{table} AS MATERIALIZED ({sql})")

    add("x", f"SELECT slot, object_id, y, unnest(range({len(features)})) AS f, unnest([{', '.join(f'({f})::DOUBLE' for f in features)}]) AS x FROM d")
    add("member0", "SELECT 0 AS created, 0::BIGINT AS f, 0.0::DOUBLE AS prior, 0.0::DOUBLE AS m0, 1.0::DOUBLE AS v0, 0.0::DOUBLE AS m1, 1.0::DOUBLE AS v1 WHERE false")
    add("beta0", "SELECT 0 AS slot, 0 AS created, 0.0::DOUBLE AS beta WHERE false")
    add("weight0", "SELECT 0 AS created, 0.0::DOUBLE AS w WHERE false")
    margin = f"SELECT x.object_id, any_value(x.y) AS y, m.created, any_value(m.prior) + coalesce(sum(0.5 * (ln(v0 / v1) + ((x - m0) ** 2 / v0 - (x - m1) ** 2 / v1))), 0) AS margin FROM {n}_x x JOIN {n}_member{{m}} m USING (f) WHERE x.slot = {{s}} GROUP BY x.object_id, m.created"
    for s in range(1, slots + 1):
        b = s - 1
        add(f"said{s}", margin.format(m=b, s=s))
        add(f"vote{s}", f"SELECT object_id, (2 * sum(CASE WHEN margin > 0 THEN w ELSE 0 END) >= sum(w))::INT AS vote FROM {n}_said{s} JOIN {n}_weight{b} USING (created) GROUP BY object_id")
        add(f"row{s}", f"SELECT d.object_id, d.y, coalesce(vote <> d.y, false)::INT AS wrong FROM d LEFT JOIN {n}_vote{s} USING (object_id) WHERE d.slot = {s}")
        least = "1.0" if s == 1 else "greatest(1e-6, least(1 - 1e-6, avg(wrong)))"
        add(f"e{s}", f"SELECT count(*) AS n, sum(wrong)::BIGINT AS k, {least} AS e, sum(wrong) + (count(*) - sum(wrong)) * {least} AS total FROM {n}_row{s}")
        add(f"w{s}", f"SELECT object_id, y, CASE WHEN wrong = 1 THEN 1 ELSE e END / total AS w FROM {n}_row{s}, {n}_e{s}")
        add(f"mean{s}", f"SELECT x.y, f, sum(w * x) / sum(CASE WHEN x IS NOT NULL THEN w END) AS m FROM {n}_x x JOIN {n}_w{s} w USING (object_id) WHERE x.slot = {s} GROUP BY x.y, f")
        add(f"var{s}", f"SELECT x.y, x.f, any_value(m) AS m, sum(w * (x - m) ** 2) / sum(CASE WHEN x IS NOT NULL THEN w END) AS v FROM {n}_x x JOIN {n}_w{s} w USING (object_id) JOIN {n}_mean{s} m ON m.y = x.y AND m.f = x.f WHERE x.slot = {s} GROUP BY x.y, x.f")
        wide = ", ".join(f"coalesce(max(m) FILTER (y = {c}), 0) AS m{c}, greatest(coalesce(max(v) FILTER (y = {c}), 1), 1e-9) AS v{c}" for c in (0, 1))
        prior = f"(SELECT CASE WHEN coalesce(sum(w) FILTER (y = 1), 0) = 0 THEN '-inf'::DOUBLE WHEN coalesce(sum(w) FILTER (y = 0), 0) = 0 THEN 'inf'::DOUBLE ELSE ln(sum(w) FILTER (y = 1) / sum(w) FILTER (y = 0)) END FROM {n}_w{s})"
        add(f"new{s}", f"SELECT {s} AS created, f, {prior} AS prior, {wide} FROM {n}_var{s} GROUP BY f")
        add(f"member{s}", f"SELECT * FROM {n}_member{b} UNION ALL SELECT * FROM {n}_new{s}")
        add(f"all{s}", margin.format(m=s, s=s))
        add(f"missed{s}", f"SELECT created, greatest(1e-6, least(0.5, sum(CASE WHEN (margin > 0)::INT <> a.y THEN w ELSE 0 END))) AS e FROM {n}_all{s} a JOIN {n}_w{s} USING (object_id) GROUP BY created")
        add(f"beta{s}", f"SELECT * FROM {n}_beta{b} UNION ALL SELECT {s}, created, e / (1 - e) FROM {n}_missed{s}")
        recent = f"(1 / (1 + exp(0.5 * (({s} - slot) - 10))))"
        add(f"weight{s}", f"SELECT created, ln(1 / least(1 - 1e-6, greatest(1e-6, sum({recent} * beta) / sum({recent})))) AS w FROM {n}_beta{s} GROUP BY created HAVING (SELECT max(n) FROM {n}_e{s}) > 0")
    every = range(1, slots + 1)
    add("weight", " UNION ALL ".join(f"SELECT {s} AS slot, created, w AS weight FROM {n}_weight{s}" for s in every))
    add("error", " UNION ALL ".join(f"SELECT {s} AS slot, (SELECT count(*) FROM {n}_weight{s - 1})::INT AS n_members, n, k AS n_wrong FROM {n}_e{s} WHERE n > 0" for s in every))
    add("judged", " UNION ALL ".join(f"SELECT {s} AS slot, object_id, created, w AS weight, margin FROM {n}_said{s} JOIN {n}_weight{s - 1} USING (created)" for s in every))
    return ",\n".join(out)
