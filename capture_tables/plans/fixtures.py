"""The driver's tables seen as capture tables.

Each view is one SQL text that Spark and DuckDB both accept: numbers are written as doubles
(`1e0`), and ELEMENT(list, k) stands for each engine's name of the k-th element, from 1.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from capture_tables.functions.shared import deal_finely

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_POSE = """
select seq, cam, frame, object, {t}, c + ux*ux*k as r00, ux*uy*k - uz*s as r01, ux*uz*k + uy*s as r02,
  uy*ux*k + uz*s as r10, c + uy*uy*k as r11, uy*uz*k - ux*s as r12,
  uz*ux*k - uy*s as r20, uz*uy*k + ux*s as r21, c + uz*uz*k as r22
from (select *, cos(angle) as c, sin(angle) as s, 1e0 - cos(angle) as k from (
  select *, {angle} as angle, (1 + event_id % 3) / n as ux, (1 + event_id % 5) / n as uy, (1 + event_id % 7) / n as uz
  from (select *, cast(seq % 5 as int) as object,
    sqrt(1e0 * ((1 + event_id % 3) * (1 + event_id % 3) + (1 + event_id % 5) * (1 + event_id % 5) + (1 + event_id % 7) * (1 + event_id % 7))) as n
    from fx_obs) a) b) d
"""

VIEWS = {
    "fx_obs": """
select user_id as seq, event_id, cast(event_id % 4 as int) as cam,
  cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame,
  value / 100e0 as x, (event_id % 97) / 97e0 as y, 2e0 + (event_id % 31) / 31e0 as z,
  (event_id % 11) / 10e0 as conf, (event_id % 13) / 12e0 as vis, event_type <> 'error' as tracked
from events""",
    "fx_pose_gt": _POSE.format(t="x as tx, y as ty, z as tz", angle="x * 6e-1"),
    "fx_pose_pr": _POSE.format(
        t="x + ((event_id % 5) - 2) * 1e-2 as tx, y as ty, z as tz", angle="x * 6e-1 + ((event_id % 7) - 3) * 5e-2"
    ),
    "fx_symmetries": """
select cast(r_regionkey as int) as object, k as sym_id,
  case k when 0 then 1e0 when 2 then -1e0 else 0e0 end as s00, case k when 1 then -1e0 when 3 then 1e0 else 0e0 end as s01, 0e0 as s02,
  case k when 1 then 1e0 when 3 then -1e0 else 0e0 end as s10, case k when 0 then 1e0 when 2 then -1e0 else 0e0 end as s11, 0e0 as s12,
  0e0 as s20, 0e0 as s21, 1e0 as s22
from (select r_regionkey, 0 as k from region union all
      select r_regionkey, 1 as k from region where r_regionkey % 2 = 0 union all
      select r_regionkey, 2 as k from region where r_regionkey % 2 = 0 union all
      select r_regionkey, 3 as k from region where r_regionkey % 2 = 0) s""",
    "fx_joints": """
select min(o_custkey) as seq, l_orderkey as frame, l_linenumber as joint, avg(l_quantity) / 50e0 as x,
  avg(l_discount) * 10e0 as y, 2e0 + avg(l_tax) * 10e0 as z
from lineitem join orders on l_orderkey = o_orderkey
group by l_orderkey, l_linenumber""",
    "fx_joints_pr": """
select seq, frame, joint, x + ((frame + joint) % 5 - 2) * 1e-2 as x, y + ((frame * 3 + joint) % 7 - 3) * 1e-2 as y,
  z + (joint % 3) * 1e-2 as z from fx_joints""",
    "fx_runs": """
select cast(frame % 7 as int) as seq, frame, role, v, u0, u0 + 1 + w as u1 from (
  select l_orderkey as frame, case when l_returnflag = 'R' then 'object' else 'person' end as role, l_linenumber as v,
    min(cast(floor(l_quantity) as int)) as u0, max(cast(round(l_discount * 100) as int)) as w
  from lineitem group by 1, 2, 3) a""",
    "fx_points": """
select cast(label as int) as cloud, cast(vec_id % 2 as int) as side, vec_id as pid, cast(ELEMENT(embedding, 1) as double) as x,
  cast(ELEMENT(embedding, 2) as double) as y, cast(ELEMENT(embedding, 3) as double) as z
from embeddings""",
    "fx_cameras": """
select cast(n_nationkey as int) as cam, 1024 as width, 768 as height, 900e0 + n_nationkey as fx, 905e0 + n_nationkey as fy, 512e0 as cx, 384e0 as cy,
  cos(n_nationkey * 2e-1) as r00, 0e0 as r01, sin(n_nationkey * 2e-1) as r02, 0e0 as r10, 1e0 as r11, 0e0 as r12,
  -sin(n_nationkey * 2e-1) as r20, 0e0 as r21, cos(n_nationkey * 2e-1) as r22,
  n_nationkey * 5e-1 as tx, n_regionkey * 25e-2 as ty, n_regionkey * 1e-1 as tz
from nation""",
    "fx_seen": """
select seq, frame, event_id, c.cam, o.x as wx, o.y as wy, o.z + 5e0 as wz, fx, fy, cx, cy, o.conf,
  c.r00 * o.x + c.r02 * (o.z + 5e0) + c.tx as px, o.y + c.ty as py, c.r20 * o.x + c.r22 * (o.z + 5e0) + c.tz as pz
from fx_obs o join fx_cameras c on c.cam < 4""",
    "fx_rays": """
select seq, frame, cam, conf, fx * px / pz + cx + ((event_id * (cam + 1)) % 5 - 2) * 1e-1 as u,
  fy * py / pz + cy + ((event_id * (cam + 2)) % 5 - 2) * 1e-1 as v
from fx_seen where pz > 1e-6""",
    "fx_depth": """
select cast(l_orderkey % 7 as int) as seq, l_orderkey as frame, l_linenumber as v, cast(floor(l_quantity) as int) as u,
  avg(l_extendedprice) / 9973e0 as z
from lineitem group by l_orderkey, l_linenumber, cast(floor(l_quantity) as int)""",
    "fx_excl": """
select distinct cast(doc_id % 150 as bigint) as seq, cast(doc_id % 60 as int) as frame from labels where quality = 0""",
    "fx_seqname": """
select concat('Date0', cast(1 + c_nationkey % 7 as varchar(9)), '_Sub0', cast(1 + c_custkey % 8 as varchar(19)), '_',
  lower(c_mktsegment), '_lift') as seq, c_custkey, c_acctbal from customer""",
    "fx_thumbs": """
select cast(vec_id as int) as idx, cast(embedding as double[]) as cells from embeddings""",
}


def _sources(sql: str) -> set[str]:
    return {m for m in re.findall(r"(?i)\b(?:from|join)\s+(\w+)", sql) if m in VIEWS or m in TABLES}


def _spark_text(sql: str) -> str:
    sql = re.sub(r"(?i)\b(from|join)(\s+)(\w+)", lambda m: f"{m[1]}{m[2]}{{{m[3]}}}" if m[3] in VIEWS or m[3] in TABLES else m[0], sql)
    return sql.replace("ELEMENT(", "element_at(").replace("double[]", "array<double>")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of `sf_dir`, or a capture view over its tables."""
    if name in TABLES:
        deal_finely(spark, f"{sf_dir}/{name}.parquet")
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_spark_text(VIEWS[name]), **{s: view(spark, sf_dir, s) for s in _sources(VIEWS[name])})


def _rounds(sql: str) -> str:
    """R6(x) written out as x rounded to six digits, without a negative zero."""
    while (at := sql.find("R6(")) >= 0:
        depth, end = 1, at + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}(round({sql[at + 3 : end - 1]}, 6) + 0e0){sql[end:]}"
    return sql


def with_views(sql: str) -> str:
    """DuckDB SQL with the capture views that it reads written before it, and R6 written out."""
    sql = _rounds(sql)
    order: list[str] = []

    def need(text: str) -> None:
        for name in sorted(_sources(text)):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                order.append(name)

    need(sql)
    if not order:
        return sql
    made = ",\n".join(f"{n} AS ({VIEWS[n].replace('ELEMENT(', 'list_extract(')})" for n in order)
    own = re.match(r"(?i)\s*with(\s+recursive)?\s", sql)
    body = ", " + sql[own.end() :] if own else "\n" + sql
    return f"WITH {'RECURSIVE ' if own and own[1] else ''}{made}{body}"
