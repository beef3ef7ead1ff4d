"""DuckDB SQL of the newer queries: what SQL can express of them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of the trees that the SQL spells out: 8**10 leaves a group, 8**4 groups.
HIGH, TOP = 10, 4

#: The 256 steps of a CRC-32, as a list ``t``.
CRC_TABLE = """t8 AS (
          SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc(octets: str) -> str:
    """CRC-32 of a list of numbers, in a query that joins ``t8``."""
    return (f"xor(list_reduce(list_prepend(4294967295, {octets}), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


def octets(text: str) -> str:
    """UTF-8 bytes of a string whose code points are below U+0800."""
    return (f"flatten(list_transform(string_split({text}, ''), lambda z: CASE WHEN unicode(z) < 128 THEN "
            "[unicode(z)::BIGINT] ELSE [192 + (unicode(z) >> 6)::BIGINT, 128 + (unicode(z) & 63)::BIGINT] END))")


def _field(x: str) -> str:
    return f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, levels: int) -> str:
    """Levels 1.. over ``{name}0 (tree, i, h)``, and for each node its siblings in its run."""
    out = []
    for k in range(levels):
        run = f"PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN"
        out.append(f"""{name}s{k} AS (
          SELECT tree, i, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                 coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r,
                 count(*) OVER (PARTITION BY tree) > 1 AS many, h
          FROM {name}{k}),
        {name}{k + 1} AS (
          SELECT tree, i // 8 AS i, CASE WHEN any_value(many) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h)
                 END AS h
          FROM {name}s{k} GROUP BY tree, i // 8)""")
    return ",\n        ".join(out)


def _ways() -> str:
    """``w{k}``: each leaf with what its siblings give up to level k, and what the claimed leaf folds to."""
    out, before = [], "w0"
    steps = [(f"gs{k}", 8 ** k, "i", "tree") for k in range(HIGH)] + [(f"ts{k}", 8 ** k, "j", "top") for k in range(TOP)]
    for at, (nodes, width, place, tree) in enumerate(steps):
        out.append(f"""w{at + 1} AS (
          SELECT w.* REPLACE (
            way || n.l || n.r AS way,
            CASE WHEN n.many THEN sha256(n.l || fold || n.r) ELSE fold END AS fold)
          FROM {before} w JOIN {nodes} n ON n.tree = w.{tree} AND n.i = w.{place} // {width})""")
        before = f"w{at + 1}"
    return ",\n        ".join(out)


def merkle() -> str:
    lowered = f"CASE WHEN {crc(octets('doc_id::VARCHAR'))} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    return f"""
        WITH {CRC_TABLE},
        leaves AS (
          SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("text")} AS leaf, {_leaf(lowered)} AS claim
          FROM documents, t8),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
        g0 AS (SELECT tree, i, leaf AS h FROM placed),
        {_levels("g", HIGH)},
        subroots AS (SELECT tree AS lang, h, row_number() OVER (ORDER BY tree) - 1 AS j FROM g{HIGH}),
        t0 AS (SELECT '' AS tree, j AS i, h FROM subroots),
        {_levels("t", TOP)},
        w0 AS (
          SELECT doc_id, leaf, p.tree, p.i, '' AS top, s.j, s.h AS subroot, '' AS way, claim AS fold
          FROM placed p JOIN subroots s ON p.tree = s.lang),
        {_ways()}
        SELECT doc_id, leaf, subroot, (SELECT h FROM t{TOP}) AS root, sha256(way) AS proof_sha256, fold AS folded_root,
               fold = (SELECT h FROM t{TOP}) AS verified
        FROM w{HIGH + TOP}"""


def spelling() -> str:
    return f"""
        WITH RECURSIVE {CRC_TABLE},
        runs AS (
          SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS w, count(*) AS c
          FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
          GROUP BY ALL),
        sums AS (SELECT w, c, {crc(octets("doc_id || ':' || w"))} AS h FROM runs, t8),
        v AS (
          SELECT w, sum(c)::BIGINT AS n FROM (
            SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INTEGER)
                        || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS w, c FROM sums)
          WHERE length(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
        less AS (
          SELECT w, k, substr(w, 1, k) || substr(w, k + 2) AS d
          FROM (SELECT w, unnest(range(length(w)))::INTEGER AS k FROM v)),
        pairs AS (
          SELECT a.w, b.w AS x FROM less a JOIN less b ON a.k = b.k AND a.d = b.d AND a.w <> b.w
          UNION SELECT less.w, v.w FROM less JOIN v ON less.d = v.w
          UNION SELECT v.w, less.w FROM less JOIN v ON less.d = v.w),
        near AS (
          SELECT p.w, count(*) AS n_near, max(m.n) AS most,
                 min(struct_pack(less := -m.n, x := p.x)).x AS x
          FROM pairs p JOIN v m ON p.x = m.w GROUP BY p.w),
        formed AS (
          SELECT v.w, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
                 CASE WHEN most >= 2 * v.n THEN near.x END AS form, CASE WHEN most >= 2 * v.n THEN most END AS form_n
          FROM v LEFT JOIN near ON v.w = near.w),
        on_way AS (
          SELECT w, w AS at FROM formed
          UNION ALL SELECT o.w, f.form FROM on_way o JOIN formed f ON o.at = f.w WHERE f.form IS NOT NULL),
        ends AS (SELECT o.w, o.at FROM on_way o JOIN formed f ON o.at = f.w WHERE f.form IS NULL)
        SELECT f.w AS word, f.form, e.at AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n
        FROM formed f JOIN ends e ON f.w = e.w"""
