"""Registry of named queries and the DuckDB SQL with the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# Named SQL relations the oracle texts start from, in dependency order (DuckDB).
RELATIONS: dict[str, str] = {
    "vec": """SELECT vec_id // 50 AS image_id, (vec_id % 50)::int AS y, (i - 1)::int AS x, 0 AS c,
        embedding[i]::double AS v
        FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)""",
    "vec8": "SELECT image_id, y, x, c, floor((v + 1) * 127.5::double)::int AS v FROM vec",
    "rgb": """SELECT vec_id // 50 AS image_id, (vec_id % 50)::int AS y, ((i - 1) // 3)::int AS x, ((i - 1) % 3)::int AS c,
        floor((coalesce(embedding[i], -1)::double + 1) * 127.5::double)::int AS v
        FROM (SELECT vec_id, embedding, unnest(range(1, 67)) AS i FROM embeddings)""",
    "rgbw": """SELECT image_id, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b
        FROM rgb GROUP BY ALL""",
    "vec_size": "SELECT image_id, 64 AS w, max(y) + 1 AS h FROM vec GROUP BY ALL",
    "ord_size": "SELECT 128 AS w, (max(o_orderkey) // 128 + 1)::int AS h FROM orders",
    "ord": """SELECT 0::bigint AS image_id, (k // 128)::int AS y, (k % 128)::int AS x, 0 AS c,
        coalesce(floor(o_totalprice * 100)::bigint % 65536, 0)::int AS v
        FROM (SELECT unnest(range(0, 128 * (SELECT h FROM ord_size))) AS k) LEFT JOIN orders ON k = o_orderkey""",
    "txt": """SELECT doc_id AS image_id, (i // 64)::int AS y, (i % 64)::int AS x, ('0x' || hx)::int AS v
        FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS hx,
                     unnest(range(0, octet_length(encode(text)))) AS i FROM documents)""",
    "txt_size": "SELECT doc_id AS image_id, 64 AS w, ceil(octet_length(encode(text)) / 64.0)::int AS h FROM documents WHERE octet_length(encode(text)) > 0",
    "band": """SELECT 0::bigint AS image_id, (i - 1)::int AS h_seq, (vec_id // 25)::int AS y, (vec_id % 25)::int AS x,
        embedding[i]::double AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)""",
    "img": """SELECT o_orderkey AS image_id, '/img/' || o_custkey || '/' || o_orderkey || '.tif' AS path, o_orderdate AS mtime,
        (floor(o_totalprice)::bigint % 9000 + 1)::int AS width, ((o_custkey * 37 + o_orderkey * 11) % 7000 + 1)::int AS height,
        [3, 1, 4][(o_orderkey % 3 + 1)::int] AS channels, [8, 12, 16, 32, 8][(o_orderkey % 5 + 1)::int] AS bpc,
        CASE WHEN o_orderkey % 5 = 3 AND o_orderkey % 2 = 0 THEN 'FLOATINGPOINT' ELSE 'FIXEDPOINT' END AS sample_type,
        CASE WHEN o_orderkey % 3 = 1 THEN 'GREYSCALE' WHEN o_orderkey % 7 = 0 THEN 'CIELAB' ELSE 'sRGB' END AS colorspace,
        (CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 72 + o_orderkey % 5 * 57 END)::float AS dpi_x,
        (CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 72 + o_orderkey % 3 * 57 END)::float AS dpi_y,
        (o_orderkey % 3)::int AS dpi_units,
        CASE WHEN o_orderkey % 2 = 0 THEN '(c) ' || o_orderpriority ELSE '' END AS rights,
        'order ' || o_orderkey AS title, o_orderstatus AS creator,
        CASE WHEN o_orderkey % 3 = 1 THEN length(o_orderpriority) END AS icc_len
        FROM orders""",
    "lvl_floor": """WITH RECURSIVE r AS (
          SELECT image_id, 0 AS native_level, width, height FROM img
          UNION ALL
          SELECT image_id, native_level + 1, width // 2, height // 2 FROM r WHERE width > 256 OR height > 256)
        SELECT image_id, (max(native_level) OVER (PARTITION BY image_id) - native_level)::int AS level, native_level, width, height,
          ceil(width / 256.0)::int AS ntx, ceil(height / 256.0)::int AS nty FROM r""",
    "lvl_ceil": """WITH RECURSIVE r AS (
          SELECT image_id, 0 AS native_level, width, height FROM img
          UNION ALL
          SELECT image_id, native_level + 1, (width + 1) // 2, (height + 1) // 2 FROM r WHERE width > 256 OR height > 256)
        SELECT image_id, (max(native_level) OVER (PARTITION BY image_id) - native_level)::int AS level, native_level, width, height,
          ceil(width / 256.0)::int AS ntx, ceil(height / 256.0)::int AS nty FROM r""",
    "req": """SELECT l_orderkey AS image_id, l_linenumber AS line, l_discount * 8 AS rx, l_tax * 9 AS ry,
        l_quantity::int / 40.0::double AS rw, l_partkey % 64 / 50.0::double AS rh,
        (CASE WHEN l_quantity::int % 3 = 0 THEN 0 ELSE l_partkey % 900 + 1 END)::int AS wid,
        (CASE WHEN l_quantity::int % 4 = 0 THEN 0 ELSE l_suppkey * 13 % 700 + 1 END)::int AS hei,
        (l_quantity::int % 4 * 90)::int AS rot, l_quantity::int % 5 = 0 AS maintain_aspect, l_quantity::int % 2 = 0 AS allow_upscaling
        FROM lineitem""",
    "view": """SELECT row_number() OVER () AS rid, q.*, width, height,
        least(greatest(CASE WHEN rw > 0 AND rh > 0 THEN rx ELSE 0 END, 0), 1) AS vx, least(greatest(CASE WHEN rw > 0 AND rh > 0 THEN ry ELSE 0 END, 0), 1) AS vy,
        least(greatest(CASE WHEN rw > 0 AND rh > 0 THEN rw ELSE 1 END, 0), 1) AS vw, least(greatest(CASE WHEN rw > 0 AND rh > 0 THEN rh ELSE 1 END, 0), 1) AS vh
        FROM req q JOIN img USING (image_id)""",
    "sized0": """SELECT *, (vw * width) / (vh * height) AS ratio, wid / (vw * width) > hei / (vh * height) AS fit_h FROM view""",
    "sized1": """SELECT *,
        CASE WHEN wid = 0 AND hei <> 0 THEN round(hei * ratio) WHEN wid = 0 THEN width WHEN hei <> 0 AND maintain_aspect AND fit_h THEN round(hei * ratio) ELSE wid END AS w0,
        CASE WHEN hei = 0 AND wid <> 0 THEN round(wid / ratio) WHEN hei = 0 THEN height WHEN wid <> 0 AND maintain_aspect AND NOT fit_h THEN round(wid / ratio) ELSE hei END AS h0
        FROM sized0""",
    "sized": """SELECT *,
        (CASE WHEN (w0 > 600 OR h0 > 600) AND w0 >= h0 THEN 600 WHEN w0 > 600 OR h0 > 600 THEN round(600 * ratio) ELSE w0 END)::int AS sw,
        (CASE WHEN (w0 > 600 OR h0 > 600) AND h0 >= w0 THEN 600 WHEN w0 > 600 OR h0 > 600 THEN round(600 / ratio) ELSE h0 END)::int AS sh
        FROM sized1""",
    "chosen": """SELECT s.rid, coalesce(max(l.native_level) FILTER (
          (CASE WHEN vw = 1 THEN l.width ELSE floor(s.width * vw / pow(2, l.native_level) + 1.1920929e-07::double) END) <= l.width + 1
          AND (CASE WHEN vh = 1 THEN l.height ELSE floor(s.height * vh / pow(2, l.native_level) + 1.1920929e-07::double) END) <= l.height + 1
          AND (wid = 0 OR (CASE WHEN vw = 1 THEN l.width ELSE floor(s.width * vw / pow(2, l.native_level) + 1.1920929e-07::double) END) >= sw)
          AND (hei = 0 OR (CASE WHEN vh = 1 THEN l.height ELSE floor(s.height * vh / pow(2, l.native_level) + 1.1920929e-07::double) END) >= sh)), 0) AS first_native
        FROM sized s JOIN lvl_floor l USING (image_id) GROUP BY s.rid""",
    "scaled": """SELECT s.*, first_native, l.level AS first_level, l.width AS fw, l.height AS fh,
        least((CASE WHEN wid = 0 AND hei > 0 THEN greatest(l.width, 1) * hei // greatest(l.height, 1) ELSE wid END) / greatest(l.width, 1)::double,
              (CASE WHEN hei = 0 AND wid > 0 THEN greatest(l.height, 1) * wid // greatest(l.width, 1) ELSE hei END) / greatest(l.height, 1)::double) AS sc0
        FROM sized s JOIN chosen USING (rid) JOIN lvl_floor l ON l.image_id = s.image_id AND l.native_level = first_native""",
    "limited": """SELECT *, greatest(first_level - (SELECT count(*) FROM (SELECT unnest(range(0, 32)) AS k) WHERE floor(floor(greatest(fw * vw, fh * vh)
          * (CASE WHEN sc0 <= 0 OR sc0 > 1 THEN 1 ELSE sc0 END)) / pow(2, k)) > 600), 0)::int AS level FROM scaled""",
    "planned": """SELECT s.*, l.native_level, l.width AS lw, l.height AS lh,
        least(round(s.width * vx / pow(2, l.native_level)), l.width)::int AS pl, least(round(s.height * vy / pow(2, l.native_level)), l.height)::int AS pt,
        round(vw * (s.width / pow(2, l.native_level)))::int AS pw0, round(vh * (s.height / pow(2, l.native_level)))::int AS ph0
        FROM limited s JOIN lvl_floor l ON l.image_id = s.image_id AND l.level = s.level""",
    "log": """SELECT event_id, ts, event_type, user_id, 'FIF=/img/' || (user_id % 10) || '.tif&WID=' || (8 + event_id % 56)
        || '&rgn=' || (event_id % 5) || 'e-1,0,0.5,0.5'
        || ['&ROT=90', '&ROT=!180', '&HEI=12px', '&HEI=20&hei=30', '', '', ''][(event_id % 7 + 1)::int]
        || ['&CNT=1.5', '&CNT=stretch', '&CNT=EQ', '&GAM=2.2', '&GAM=log', ''][(event_id % 6 + 1)::int]
        || ['&INV=1', '&CMP=JET', '&SHD=45,30', '&CTW=%5B1,0,0;0,1,0;0,0,1%5D', '&CNV=[sobel]', '&COL=gray',
            '&MINMAX=0:5,200', '&SDS=3,90', '&QLT=80', '&MINMAX=-:1e1,2.5e2&FOO=1&=x&BAR=', '&SPECTRA=0,0,1,2'][(event_id % 11 + 1)::int]
        || '&CVT=' || CASE WHEN event_id % 2 = 0 THEN 'png' ELSE 'tiff' END AS q FROM events""",
}


def _needed(text: str, have: set[str]) -> set[str]:
    import re

    for name, body in RELATIONS.items():
        if name not in have and re.search(rf"(?<![\w.']){name}(?![\w(])", text):
            have.add(name)
            _needed(body, have)
    return have


def with_relations(text: str) -> str:
    """Prefix the named relations a query mentions."""
    names = _needed(text, set())
    ctes = ", ".join(f"{n} AS ({body})" for n, body in RELATIONS.items() if n in names)
    text = text.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {ctes}, {text[5:]}" if ctes else text
    return f"WITH {ctes} {text}" if ctes else text


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB form, without the named relations."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_relations(sql)
        return fn

    return add
