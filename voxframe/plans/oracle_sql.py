"""SQL text of the adapters, as common table expressions for the comparison engine."""

from __future__ import annotations

CTES = {
    "vox": """
        select l_orderkey // 3000 as volume_id, cast(l_quantity as bigint) - 1 as i,
               cast(round(l_discount * 100) as bigint) as j, cast(round(l_tax * 100) as bigint) as k,
               cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / (count(*) * 100) as value_a,
               cast(sum(cast(round(l_extendedprice * 100) as bigint)
                        * (100 - cast(round(l_discount * 100) as bigint))) as double) / (count(*) * 10000) as value_b
        from lineitem group by 1, 2, 3, 4""",
    "vox_a": "select volume_id, i, j, k, value_a as value from vox",
    "vox_b": "select volume_id, i, j, k, value_b as value from vox",
    "metrics": """
        select volume_id, i, j, k, 'a' as metric, value_a as value from vox
        union all select volume_id, i, j, k, 'b', value_b from vox""",
    "pts": """
        select event_id // 2000 as volume_id, event_id as point_id,
               cast(user_id % 150 + (event_id % 7) / cast(7 as double) as double) as x,
               value / cast(5 as double) as y,
               cast(hour(ts) + minute(ts) / cast(60 as double) as double) as z, event_type
        from events""",
    "circles": "select volume_id, point_id, x, y, cast(0 as double) as z from pts",
    "image": """
        select p_partkey // 4096 as volume_id, p_partkey % 64 as i, (p_partkey // 64) % 64 as j,
               cast(0 as bigint) as k, p_retailprice as value from part""",
    "field2": """
        select l_orderkey // 500 as volume_id, l_partkey % 48 as i, (l_suppkey + 7 * l_linenumber) % 48 as j,
               cast(0 as bigint) as k, max(l_quantity) as value from lineitem group by 1, 2, 3, 4""",
    "mask2": "select volume_id, i, j, k from field2 where value > 38",
    "seeds2": "select volume_id, i, j, k, i * 48 + j + 1 as label from field2 where value > 49",
    "labels2": "select volume_id, i, j, k, 1 + (i // 6) * 8 + j // 6 as label from field2 where value > 20",
    "field3": """
        select l_orderkey // 2000 as volume_id, l_partkey % 16 as i, l_orderkey % 16 as j, l_suppkey % 8 as k,
               max(l_quantity) as value from lineitem group by 1, 2, 3, 4""",
    "mask3": "select volume_id, i, j, k from field3 where value > 20",
    "cloud": """
        select cast(label as bigint) as volume_id, vec_id * 1000 + n as point_id, cast(embedding[3 * n + 1] as double) as x,
               coalesce(cast(embedding[3 * n + 2] as double), 0) as y, coalesce(cast(embedding[3 * n + 3] as double), 0) as z
        from (select *, unnest(range((len(embedding) + 2) // 3)) as n from embeddings)""",
    "plane": """
        select * from (select l_orderkey // 4000 as volume_id, l_partkey % 128 as i,
               (l_suppkey + 13 * l_linenumber) % 96 as j, cast(0 as bigint) as k, max(l_quantity) as value
        from lineitem group by 1, 2, 3, 4) where value > 20""",
    "patches": """
        select volume_id, cast(r.n * 4 + c.n as bigint) as patch_index, cast(0 as bigint) as z0, cast(1 as bigint) as z1,
               cast(y0 as bigint) as y0, cast(y0 + 48 as bigint) as y1, cast(x0 as bigint) as x0, cast(x0 + 48 as bigint) as x1
        from (select distinct l_orderkey // 4000 as volume_id from lineitem),
             (values (0, 0), (1, 36), (2, 48)) r(n, y0), (values (0, 0), (1, 36), (2, 72), (3, 80)) c(n, x0)""",
    "patch_labels": """
        select p.volume_id, patch_index, i, j, k,
               1 + ((i - x0 + patch_index % 3) // 6) * 9 + (j - y0 + patch_index % 2) // 6 as local_label
        from plane p join patches q on p.volume_id = q.volume_id and i >= x0 and i < x1 and j >= y0 and j < y1""",
    "varied_grids": """
        select volume_id, max(i) + 1 as nx, max(j) + 1 as ny, max(k) + 1 as nz,
               cast(case when volume_id % 2 = 0 then 1 else -1 end * (3 + volume_id % 3) as double) as sx,
               cast(9 as double) as sy, cast(2.5 as double) as sz,
               cast(volume_id as double) as ox, cast(-2 as double) as oy, cast(0.5 as double) as oz,
               case volume_id % 3 when 0 then 'um' when 1 then 'mm' else 'micron' end as unit,
               cast(case volume_id % 3 when 1 then 1000 else 1 end as double) as um,
               volume_id % 2 as code
        from vox group by volume_id""",
    # cells of the coarse grid that the points fall into
    "cells": """
        select * from (
            select volume_id, point_id, cast(floor((x + 0.5) / cast(3 as double)) as bigint) as i,
                   cast(floor((y + 0.5) / cast(9 as double)) as bigint) as j,
                   cast(floor((z + 0.5) / (cast(24 as double) / cast(9 as double))) as bigint) as k
            from pts where x >= -0.5 and x < 149.5 and y >= -0.5 and y < 99.5 and z >= -0.5 and z < 23.5)
        where i between 0 and 49 and j between 0 and 10 and k between 0 and 8""",
    "counts": "select volume_id, i, j, k, count(*) as n_points from cells group by 1, 2, 3, 4",
    # both maps next to the point density of their voxel
    "pairs": """
        select m.volume_id, m.metric, m.i, m.j, m.k, m.value,
               cast(coalesce(n_points, 0) as double) / (cast(3 as double) * 9 * (cast(24 as double) / 9)) * 8000 as density
        from metrics m left join counts c using (volume_id, i, j, k)""",
}

# which expression needs which (direct needs only)
NEEDS = {
    "vox_a": ["vox"], "vox_b": ["vox"], "metrics": ["vox"], "circles": ["pts"], "mask2": ["field2"],
    "seeds2": ["field2"], "labels2": ["field2"], "mask3": ["field3"], "patch_labels": ["plane", "patches"],
    "varied_grids": ["vox"], "cells": ["pts"], "counts": ["cells"], "pairs": ["metrics", "counts"],
}


def compose(names: str, body: str, extra: dict[str, str] | None = None, recursive: bool = False, stored: tuple[str, ...] = ()) -> str:
    """``body`` below the named adapters (blank separated) and their needs, then ``extra`` expressions; ``stored`` ones are computed once."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in NEEDS.get(name, []):
            visit(need)
        ordered.append(name)

    for name in names.split():
        visit(name)
    how = lambda name: " as materialized " if name in stored else " as "
    parts = [f"{name}{how(name)}({CTES[name]})" for name in ordered]
    parts += [f"{name}{how(name)}({text})" for name, text in (extra or {}).items()]
    keyword = "with recursive " if recursive else "with "
    return keyword + ",\n".join(parts) + "\n" + body
