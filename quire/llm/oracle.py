"""DuckDB SQL of the queries that SQL can express. The others are tested against brute force.

op1, op3, op5, op6, op7, op9: crc32, xxhash64 or trained models, which DuckDB does not have.
"""

from __future__ import annotations

from quire.llm.license_scan import PHRASES
from quire.llm.mixing import SEED

_GAP = r"( [^ ]+)"
# label -> regular expression over " w1 w2 ... " (one blank between words)
_ACCEPTED = {
    "apache-2.0": r" licensed under the apache license version 2 0 ",
    "gpl-3.0": r" licensed under (the terms of )?the gnu general public license version 3 ",
    "gpl-2.0": r" licensed under (the terms of )?the gnu general public license version 2 ",
    "mit-notice": r" (released|licensed|distributed|available) under the (terms of the )?mit license ",
    "cc-by-4.0": r" licensed under (a )?(creative commons|cc) (by|attribution) 4 0 ",
    "cc-by-nc-4.0": r" licensed under (a )?(creative commons|cc) (by|attribution) (nc|noncommercial) 4 0 ",
    "cc-by-sa-4.0": r" licensed under (a )?(creative commons|cc) (by|attribution) (sa|sharealike) 4 0 ",
    "bsd-head": r" redistribution and use in source and binary forms with or without modification are permitted provided that "
                r"the following conditions are met ",
    "mit-grant": r" permission is hereby granted free of charge to any person obtaining a copy of" + _GAP + r"{1,6} to deal in"
                 + _GAP + r"{1,4} without restriction ",
    "all-rights": r" copyright (c )?" + r"([^ ]+ ){1,6}all rights reserved ",
}


def _op2() -> str:
    places = "\nUNION ALL ".join(
        f"SELECT doc_id, k, i - 1 AS word, '{label}' AS label FROM w, range(1, greatest(len(ws), 1) + 1) r(i) "
        f"WHERE ws[i:i + {len(p.split()) - 1}] = {p.split()!r}"
        for p, label in PHRASES.items()
    )
    labels = "\nUNION ALL ".join(f"SELECT k, '{label}' AS label FROM w WHERE regexp_matches(j, '{rx}')" for label, rx in _ACCEPTED.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS j FROM d),
p AS ({places}),
b AS (SELECT k, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY k),
t AS ({labels}),
s AS (SELECT k, count(*) AS n_templates FROM t GROUP BY k),
a AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM (SELECT k, label FROM p UNION ALL SELECT k, label FROM t) GROUP BY k)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base,
       b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
       coalesce(b.base_labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
       CASE WHEN s.n_templates > 0 THEN 1.0 WHEN b.n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM w LEFT JOIN b USING (k) LEFT JOIN s USING (k) LEFT JOIN a USING (k)
"""


_OP4 = f"""
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
             md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS okey FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT *, cap / weight <= lev AS is_full, max(CASE WHEN cap / weight > lev THEN lev END) OVER () AS line FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full OR line IS NULL THEN cap ELSE least(cap, line * weight) END AS target FROM f),
g AS (SELECT r.*, t.source_size, t.target, round(t.target)::BIGINT AS goal,
             CASE WHEN t.source_size > 0 THEN floor(round(t.target) / t.source_size) ELSE 0 END::BIGINT AS epochs,
             (sum(r.size) OVER (PARTITION BY r.source ORDER BY okey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - r.size)::BIGINT AS before
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, goal - epochs * source_size - before)))::BIGINT AS taken FROM g
"""

_OP10 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max(list_inner_product(q.e, c.e)) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP8 = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS MATERIALIZED (SELECT k, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
n AS MATERIALIZED (SELECT k, source, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS t FROM l),
b AS (SELECT t FROM n WHERE t <> '' GROUP BY t HAVING count(DISTINCT coalesce('=' || source, '')) >= 5),
m AS (SELECT n.k, n.pos, n.line, b.t IS NOT NULL AS bad FROM n LEFT JOIN b USING (t)),
c AS (SELECT k, count(*) AS n_lines, sum(bad::INT) AS removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS clean FROM m GROUP BY k)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE c.n_lines END::BIGINT AS n_lines, c.removed::BIGINT AS removed_lines,
       md5(c.clean) AS clean_md5
FROM d JOIN c USING (k)
"""

ORACLE: dict[str, str] = {"op8_line_dedup": _OP8, "op2_license_scan": _op2(), "op4_mixing": _OP4, "op10_nearest": _OP10}
