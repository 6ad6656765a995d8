"""Tables that stand in for scanned images in the driver's queries: derived from ``embeddings``, in both dialects.

Signs of a vector's 64 numbers are a hash; copies differ from it by a few bits.
"""

from __future__ import annotations

_MASKS = "values (0,0,0,0),(1,1,3,7),(2,15,1023,8191),(3,511,262143,4095)"


def _records(bits: str, shifted, div: str) -> str:
    hashes = ", ".join(f"{shifted(m)} as {name}" for name, m in (("phash", "pm"), ("dhash", "dm"), ("whash", "wm")))
    return f"""
select concat('/img/', cast(vec_id as string), '_', cast(k as string), case when k = 2 then '.png' else '.jpg' end) as path,
  cast(50000 + (vec_id % 97) * 1000 + k * 10 as bigint) as file_size, cast(1700000000 + vec_id * 60 - k as double) as mtime,
  {hashes}, cast(400 + (vec_id % 7) * 200 as int) as width,
  cast((400 + (vec_id % 5) * 150) {div} (case when k = 3 then 2 else 1 end) as int) as height, embedding as color_hist, vec_id, k
from ({bits}) b cross join (select * from ({_MASKS}) as v(k, pm, dm, wm)) m where k = 0 or vec_id % 5 < k
"""


SPARK_RECORDS = _records(
    "select vec_id, embedding, aggregate(transform(embedding, (x, i) -> if(x > 0f, shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x) as h from embeddings",
    lambda m: f"h ^ shiftleft(cast({m} as bigint), cast(vec_id % 40 as int))",
    "div",
)
DUCK_RECORDS = _records(
    """select vec_id, embedding, (case when v >= 9223372036854775808::hugeint then v - 18446744073709551616::hugeint else v end)::bigint as h
from (select vec_id, any_value(embedding) as embedding, sum(case when x > 0 then (1::hugeint << i::int) else 0::hugeint end) as v
  from (select vec_id, embedding, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding) as x from embeddings) group by vec_id)""",
    lambda m: f"xor(h, ({m}::bigint << (vec_id % 40)::int))",
    "//",
)
