"""The two fixture views (FIXTURES.md section 2) over the driver tables.

``pairs`` gives the corpus shape (row_id, shard, edit_type, instruction,
caption, decodable) from ``orders``; ``images`` gives 3 x 8 x 8 CHW pixel
arrays from ``part``. Both are plain projections, so Catalyst prunes the scan
to the one or two source columns they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import spread

IMAGE_SIDE = 8
IMAGE_CHANNELS = 3
IMAGE_PIXELS = IMAGE_CHANNELS * IMAGE_SIDE * IMAGE_SIDE

_ET = ("case (cast(floor(o_orderkey/100) as bigint)+case when o_orderkey%100>=90 then 1 else 0 end)%5 "
       "when 0 then 'add' when 1 then 'tune_transfer' when 2 then 'style_change' "
       "when 3 then 'background_change' when 4 then 'replace' end")

_INSTRUCTION = """case et when 'add' then concat(
   case cast(floor(o_orderkey/5) as bigint)%6 when 0 then 'add' when 1 then 'include' when 2 then 'put' when 3 then 'place' when 4 then 'insert' when 5 then 'Add' end,' ',
   case cast(floor(o_orderkey/3) as bigint)%5 when 0 then 'a ' when 1 then 'an ' when 2 then 'the ' when 3 then 'some ' when 4 then '' end,
   case (o_orderkey*5)%4 when 0 then '' when 1 then 'big red ' when 2 then 'small ' when 3 then 'fresh ' end,
   case (o_orderkey*3+cast(floor(o_orderkey/7) as bigint))%14 when 0 then 'hat' when 1 then 'cats' when 2 then 'butterflies' when 3 then 'vases' when 4 then 'cup' when 5 then 'glasses' when 6 then 'bookshelf' when 7 then 'zebra' when 8 then 'dog' when 9 then 'boxes' when 10 then 'apple' when 11 then 'balloon' when 12 then 'sailboats' when 13 then 'tree' end,
   case cast(floor(o_orderkey/11) as bigint)%6 when 0 then ' on the horse' when 1 then ' of coffee in his hand' when 2 then ' nearby' when 3 then '' when 4 then ' taking a bath' when 5 then ' to the left' end)
  when 'tune_transfer' then case cast(floor(o_orderkey/2) as bigint)%11 when 0 then 'change the weather to snow' when 1 then 'make the season autumn' when 2 then 'make it a snowy night' when 3 then 'change the time to dusk' when 4 then 'let it fall' when 5 then 'make the weather foggy' when 6 then 'turn it to stormy evening' when 7 then 'brighten the room' when 8 then 'make it summer' when 9 then 'change the season to winter' when 10 then 'mist at midnight' end
  when 'replace' then 'replace the dog with a cat'
  else concat('apply ',et) end"""

_CAPTION = ("case o_orderkey%16 when 0 then 'make it a watercolor painting' when 1 then 'make it rain' "
            "when 2 then 'put her on a train' when 3 then 'turn it into a snowy day' when 4 then 'ride a bicycle' "
            "when 5 then 'make it an anime' when 6 then 'make it a desert' when 7 then 'set it on fire' "
            "when 8 then 'make it night' when 9 then 'the knight at dawn' when 10 then 'make it cyberpunk' "
            "when 11 then 'a charcoal sketch' when 12 then 'make her a panda' when 13 then 'make it the Taj Mahal' "
            "when 14 then 'add a hat' when 15 then 'make it black and white' end")

PAIRS_COLUMNS = ["row_id", "shard", "edit_type", "edit_type_nullable", "instruction",
                 "caption", "decodable"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts, spread over the cluster by ``doc_id``."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _pick(values, index_sql: str) -> str:
    """``values[index]`` as an array lookup (0-based index expression).

    The index is taken ``pmod`` the list length, which changes nothing for
    the table's own keys (already in range) but keeps the lookup total:
    Catalyst may copy a filter on these columns to the other side of an
    equi-join on ``o_orderkey`` (inferred constraints), where keys outside
    the table's range (e.g. -1) exist, and an index of 0 fails under ANSI.
    """
    arr = "array(" + ", ".join("'" + v + "'" for v in values) + ")"
    return f"element_at({arr}, cast(pmod({index_sql}, {len(values)}) as int) + 1)"


# The same values as the CASE text above, as array lookups: a few small
# expressions instead of nested CASEs, so Catalyst can inline them cheaply.
_ET_FAST = _pick(["add", "tune_transfer", "style_change", "background_change", "replace"],
                 "(cast(floor(o_orderkey/100) as bigint) + if(o_orderkey%100>=90, 1, 0)) % 5")
_ADD_FAST = ("concat(" + ", ".join([
    _pick(["add", "include", "put", "place", "insert", "Add"], "cast(floor(o_orderkey/5) as bigint)%6"),
    "' '",
    _pick(["a ", "an ", "the ", "some ", ""], "cast(floor(o_orderkey/3) as bigint)%5"),
    _pick(["", "big red ", "small ", "fresh "], "(o_orderkey*5)%4"),
    _pick(["hat", "cats", "butterflies", "vases", "cup", "glasses", "bookshelf", "zebra", "dog",
           "boxes", "apple", "balloon", "sailboats", "tree"],
          "(o_orderkey*3+cast(floor(o_orderkey/7) as bigint))%14"),
    _pick([" on the horse", " of coffee in his hand", " nearby", "", " taking a bath", " to the left"],
          "cast(floor(o_orderkey/11) as bigint)%6"),
]) + ")")
_TUNE_FAST = _pick(["change the weather to snow", "make the season autumn", "make it a snowy night",
                    "change the time to dusk", "let it fall", "make the weather foggy",
                    "turn it to stormy evening", "brighten the room", "make it summer",
                    "change the season to winter", "mist at midnight"],
                   "cast(floor(o_orderkey/2) as bigint)%11")
_CAPTION_FAST = _pick(["make it a watercolor painting", "make it rain", "put her on a train",
                       "turn it into a snowy day", "ride a bicycle", "make it an anime",
                       "make it a desert", "set it on fire", "make it night", "the knight at dawn",
                       "make it cyberpunk", "a charcoal sketch", "make her a panda",
                       "make it the Taj Mahal", "add a hat", "make it black and white"],
                      "o_orderkey%16")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus-shaped view over ``orders`` (one row per before/after pair)."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").withColumn(
        "et", F.expr(_ET_FAST))
    return o.selectExpr(
        "o_orderkey as row_id",
        "cast(floor(o_orderkey/100) as bigint) as shard",
        "et as edit_type",
        "case when o_orderkey%7=3 then cast(null as string) else et end as edit_type_nullable",
        f"case et when 'add' then {_ADD_FAST} when 'tune_transfer' then {_TUNE_FAST} "
        "when 'replace' then 'replace the dog with a cat' else concat('apply ', et) end as instruction",
        f"{_CAPTION_FAST} as caption",
        "(o_orderkey%97)<>0 as decodable",
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img_id, px): 192 ints 0..255, 3 x 8 x 8 CHW, from ``part``."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").selectExpr(
        "p_partkey as img_id",
        # i*17 and (i*i)%7 of every pixel i as two constant lists
        f"zip_with({_ints(i * 17 for i in range(IMAGE_PIXELS))}, {_ints(i * i % 7 for i in range(IMAGE_PIXELS))}, "
        "(a, b) -> (p_partkey*31 + a + b*p_size)%256) as px")


def _ints(values) -> str:
    return f"array({', '.join(map(str, values))})"


def images_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img_id, res, px BINARY): the same pixels as packed uint8 bytes, the
    storage form the NumPy image jobs read."""
    from .operators.images import array_to_u8
    return array_to_u8(images(spark, sf_dir), "px", "px").withColumn(
        "res", F.lit(IMAGE_SIDE).cast("int"))


# DuckDB text of the same two views, used as CTEs by the oracle queries.
PAIRS_SQL = f"""select o_orderkey as row_id, cast(floor(o_orderkey/100) as bigint) as shard,
 et as edit_type,
 case when o_orderkey%7=3 then cast(null as varchar) else et end as edit_type_nullable,
 {_INSTRUCTION} as instruction,
 {_CAPTION} as caption,
 (o_orderkey%97)<>0 as decodable
from (select *, {_ET} as et from orders)"""

IMAGES_SQL = ("select p_partkey as img_id, list_transform(range(0,192), lambda i: "
              "(p_partkey*31 + i*17 + ((i*i)%7)*p_size)%256) as px from part")
