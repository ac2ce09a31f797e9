"""Places: a small gazetteer with name resolution, geographic filters, grids and clusters."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.shared import written

#: Well-known places as (name, other names, latitude, longitude, radius in km).
PLACES = (
    ("Beijing", "北京 peking", 39.9042, 116.4074, 80), ("Shanghai", "上海", 31.2304, 121.4737, 60), ("Hong Kong", "香港", 22.3193, 114.1694, 35), ("Tokyo", "东京 東京", 35.6762, 139.6503, 60),
    ("Kyoto", "京都", 35.0116, 135.7681, 25), ("Osaka", "大阪", 34.6937, 135.5023, 30), ("Seoul", "首尔", 37.5665, 126.978, 35), ("Singapore", "新加坡", 1.3521, 103.8198, 30),
    ("Bangkok", "曼谷", 13.7563, 100.5018, 40), ("Sydney", "悉尼", -33.8688, 151.2093, 50), ("London", "伦敦", 51.5074, -0.1278, 40), ("Paris", "巴黎", 48.8566, 2.3522, 30),
    ("Berlin", "柏林", 52.52, 13.405, 35), ("Rome", "罗马 roma", 41.9028, 12.4964, 25), ("Madrid", "马德里", 40.4168, -3.7038, 30), ("Amsterdam", "", 52.3676, 4.9041, 20),
    ("Vienna", "wien", 48.2082, 16.3738, 25), ("New York", "nyc 纽约", 40.7128, -74.006, 50), ("San Francisco", "sf 旧金山", 37.7749, -122.4194, 40), ("Los Angeles", "la 洛杉矶", 34.0522, -118.2437, 60),
    ("Chicago", "", 41.8781, -87.6298, 40), ("Toronto", "", 43.6532, -79.3832, 40), ("Mexico City", "", 19.4326, -99.1332, 50), ("Rio de Janeiro", "rio", -22.9068, -43.1729, 45),
    ("Cairo", "", 30.0444, 31.2357, 40), ("Cape Town", "", -33.9249, 18.4241, 40), ("Fiji", "斐济", -17.7134, 178.065, 250), ("Iceland", "冰岛", 64.9631, -19.0208, 300),
    ("Guangzhou", "广州", 23.1291, 113.2644, 60), ("Shenzhen", "深圳", 22.5431, 114.0579, 40), ("Chengdu", "成都", 30.5728, 104.0668, 60), ("Hangzhou", "杭州", 30.2741, 120.1551, 50),
    ("Nanjing", "南京", 32.0603, 118.7969, 50), ("Wuhan", "武汉", 30.5928, 114.3055, 60), ("Chongqing", "重庆", 29.563, 106.5516, 80), ("Suzhou", "苏州", 31.2989, 120.5853, 40),
    ("Tianjin", "天津", 39.3434, 117.3616, 60), ("Qingdao", "青岛", 36.0671, 120.3826, 50), ("Xiamen", "厦门", 24.4798, 118.0894, 30), ("Kunming", "昆明", 24.8801, 102.8329, 50),
    ("Harbin", "哈尔滨", 45.8038, 126.535, 50), ("Sanya", "三亚", 18.2528, 109.5119, 40), ("Lhasa", "拉萨", 29.652, 91.1721, 40), ("Macau", "澳门", 22.1987, 113.5439, 15),
    ("Taipei", "台北", 25.033, 121.5654, 30), ("Sapporo", "札幌", 43.0618, 141.3545, 35), ("Nagoya", "名古屋", 35.1815, 136.9066, 30), ("Okinawa", "冲绳", 26.5, 127.9, 80),
    ("Busan", "釜山", 35.1796, 129.0756, 30), ("Hanoi", "河内", 21.0278, 105.8342, 35), ("Kuala Lumpur", "吉隆坡", 3.139, 101.6869, 35), ("Jakarta", "雅加达", -6.2088, 106.8456, 45),
    ("Bali", "巴厘岛", -8.4095, 115.1889, 90), ("Manila", "马尼拉", 14.5995, 120.9842, 35), ("Phuket", "普吉", 7.8804, 98.3923, 35), ("Mumbai", "孟买", 19.076, 72.8777, 45),
    ("Delhi", "德里", 28.7041, 77.1025, 50), ("Kathmandu", "加德满都", 27.7172, 85.324, 30), ("Dubai", "迪拜", 25.2048, 55.2708, 50), ("Istanbul", "伊斯坦布尔", 41.0082, 28.9784, 50),
    ("Moscow", "莫斯科", 55.7558, 37.6173, 50), ("Athens", "雅典", 37.9838, 23.7275, 30), ("Barcelona", "巴塞罗那", 41.3851, 2.1734, 25), ("Lisbon", "里斯本", 38.7223, -9.1393, 25),
    ("Milan", "米兰", 45.4642, 9.19, 25), ("Venice", "威尼斯", 45.4408, 12.3155, 20), ("Florence", "佛罗伦萨", 43.7696, 11.2558, 15), ("Naples", "那不勒斯", 40.8518, 14.2681, 25),
    ("Munich", "慕尼黑", 48.1351, 11.582, 30), ("Hamburg", "汉堡", 53.5511, 9.9937, 30), ("Prague", "布拉格", 50.0755, 14.4378, 25), ("Budapest", "布达佩斯", 47.4979, 19.0402, 25),
    ("Warsaw", "华沙", 52.2297, 21.0122, 30), ("Zurich", "苏黎世", 47.3769, 8.5417, 20), ("Geneva", "日内瓦", 46.2044, 6.1432, 20), ("Brussels", "布鲁塞尔", 50.8503, 4.3517, 20),
    ("Copenhagen", "哥本哈根", 55.6761, 12.5683, 25), ("Stockholm", "斯德哥尔摩", 59.3293, 18.0686, 30), ("Oslo", "奥斯陆", 59.9139, 10.7522, 25), ("Helsinki", "赫尔辛基", 60.1699, 24.9384, 25),
    ("Dublin", "都柏林", 53.3498, -6.2603, 25), ("Edinburgh", "爱丁堡", 55.9533, -3.1883, 20), ("Seattle", "西雅图", 47.6062, -122.3321, 40), ("Las Vegas", "拉斯维加斯", 36.1699, -115.1398, 35),
    ("Boston", "波士顿", 42.3601, -71.0589, 30), ("Miami", "迈阿密", 25.7617, -80.1918, 40), ("Hawaii", "夏威夷", 20.7967, -156.3319, 350), ("Vancouver", "温哥华", 49.2827, -123.1207, 30),
    ("Montreal", "蒙特利尔", 45.5019, -73.5674, 30), ("Buenos Aires", "", -34.6037, -58.3816, 40), ("Lima", "利马", -12.0464, -77.0428, 35), ("Santiago", "圣地亚哥", -33.4489, -70.6693, 35),
    ("Nairobi", "内罗毕", -1.2921, 36.8219, 30), ("Marrakesh", "马拉喀什", 31.6295, -7.9811, 25), ("Melbourne", "墨尔本", -37.8136, 144.9631, 45), ("Auckland", "奥克兰", -36.8509, 174.7645, 40),
)
#: Endings that a place name may carry.
SUFFIXES = ("特别行政区", "自治区", "省", "市", "区", "县", " city", " province", " county", " island")
ENDS = "(" + "|".join(s.replace(" ", r"\s") for s in SUFFIXES) + ")+$"
_ENDING = re.compile(ENDS)


def names_of(name: str) -> list[str]:
    """The name in lower case, and what is left as its endings are taken off, one after another."""
    out = [" ".join(name.lower().split())]
    while True:
        shorter = next((out[-1][: -len(s)].strip() for s in SUFFIXES if out[-1].endswith(s) and len(out[-1]) > len(s)), None)
        if not shorter or shorter in out:
            return out
        out.append(shorter)


def gazetteer(spark: SparkSession, places: tuple = PLACES) -> DataFrame:
    """(key, place, latitude, longitude, radius): one row per name."""
    rows = [(key, name, float(lat), float(lon), float(km)) for name, others, lat, lon, km in places for n in (name, *others.split()) for key in names_of(n)]
    return spark.createDataFrame(list(dict.fromkeys(rows)), "key string, place string, latitude double, longitude double, radius double")


def resolve(mentions: DataFrame, places: DataFrame, column: str = "mention") -> DataFrame:
    """mentions with place, tier (1 exact, 2 without endings, 3 longest prefix of words or characters), matched key, and box; null if none.

    Keys of a mention are generated and joined with the gazetteer; the best tier and longest key win. `mention` values should be distinct."""
    said = F.trim(F.regexp_replace(F.lower(F.col(column)), r"\s+", " "))
    words = F.split(said, " ")
    by_word = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))
    by_char = F.when(F.length(said) >= 2, F.transform(F.sequence(F.lit(2), F.greatest(F.length(said), F.lit(2))), lambda k: F.substring(said, F.lit(1), k))).otherwise(F.array().cast("array<string>"))
    tiers = ((1, F.array(said)), (2, F.array(F.regexp_replace(said, ENDS, ""))), (3, F.concat(by_word, by_char)))

    def tiered(tier: int, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(tier).alias("tier"), k.alias("key")))

    keys = F.flatten(F.array(*(tiered(*t) for t in tiers)))
    asked = mentions.select(column).distinct().withColumn("_k", F.explode(keys)).select(column, "_k.tier", "_k.key").distinct()
    best = F.min_by(F.struct("place", "tier", "key", "latitude", "longitude", "radius"), F.struct("tier", -F.length("key"), "place"))
    found = asked.join(F.broadcast(places), "key").groupBy(column).agg(best.alias("b")).select(column, "b.*")  # gazetteer: a list in the program
    b = geo.box(F.col("latitude"), F.col("longitude"), F.col("radius"))
    found = found.select(column, "place", "tier", "key", *(b[k].alias(k) for k in ("south", "north", "west", "east", "crosses")))
    return mentions.join(found, column, "left")


#: Longest run, in characters, that spaces around a name add to; and longest run that is looked for inside a clause, unless the whole search is asked for.
INSIDE = 8
#: Clauses that a task holds as texts at a time, of those that come in one Arrow batch.
TEXTS = 256


def _endings(text: str, at: int, room: int) -> list[int]:
    """Lengths of the chains of endings that begin at a place of a text, up to room."""
    out, open_ = set(), [0]
    while open_:
        n = open_.pop()
        more = [n + len(s) for s in SUFFIXES if n + len(s) <= room and text.startswith(s, at + n)]
        open_ += [m for m in more if m not in out]
        out.update(more)
    return sorted(out)


#: One ending; none begins with another, so a chain of them has one reading from where it begins.
_ONE = re.compile("|".join(map(re.escape, SUFFIXES)))


class _Chains:
    """Ends of the chains of endings in a text. The last chain walked is held, so chains that overlap are walked once."""

    def __init__(self, text: str) -> None:
        self.text, self.path = text, array("q")

    def end(self, at: int) -> int:
        """Where the chain that begins at a place ends; the place itself if none does."""
        walked = array("q", [at])
        while True:
            k = bisect_left(self.path, walked[-1])
            if k < len(self.path) and self.path[k] == walked[-1]:
                return self.path[-1]
            one = _ONE.match(self.text, walked[-1])
            if not one:
                self.path = walked
                return walked[-1]
            walked.append(one.end())


class _Lower(dict):
    """Characters in lower case, one by one; those that become two are no part of a name."""

    def __missing__(self, point: int) -> str:
        low = chr(point).lower()
        self[point] = out = low if len(low) == 1 else "\0"
        return out


_LOWER = _Lower()


def _beyond(text: str, at: int, name: str, chains: _Chains) -> int:
    """Length of the chain of endings after a name that makes a core longer than INSIDE; 0 if none does, or if an ending begins inside the name."""
    one = _ONE.match(text, at)
    if not one or _ENDING.sub("", name + one[0]) != name:
        return 0
    n = chains.end(at) - at
    return n if len(name) + n > INSIDE else 0


def _longest(said: str, names: ahocorasick.Automaton, whole: bool = False) -> tuple[int, int, list[str]] | None:
    """(at from 1, length, names) of the longest run that is a name, the leftmost of these. Only the best run so far is held, and nothing as long as the text but its lower case (and the ends of one chain of endings)."""
    text = said.translate(_LOWER)
    best: tuple[int, int] = (0, 0)
    found: list[str] = []
    chains = _Chains(text)
    for last, name in names.iter(text):
        start = last + 1 - len(name)
        far = _beyond(text, last + 1, name, chains) if whole else 0
        for ending in (0, *_endings(text, last + 1, INSIDE - len(name)), *([far] if far else [])):
            size = len(name) + ending
            if ending and ending != far and _ENDING.sub("", text[start : start + size]) != name:
                continue
            room, end = max(0, INSIDE - size), start + size
            left = text[max(0, start - room) : start]
            before = len(left) - len(left.rstrip(" "))
            right = text[end : end + room - before]
            total = size + before + len(right) - len(right.lstrip(" "))
            run = -total, start - before
            if total >= 2 and (not found or run < best):
                best, found = run, [name]
            elif total >= 2 and run == best:
                found.append(name)
    return (best[1] + 1, -best[0], found) if found else None


def longest_exact(clauses: DataFrame, places: DataFrame, key: str = "request_id", column: str = "clause", whole: bool = False) -> DataFrame:
    """(key, place, at, length, remainder and the place's numbers) of the clauses that hold a place's whole name: the longest run of 2 characters or more
    that is one, with or without endings, the leftmost of these; spaces around the name belong to the run, as far as it has INSIDE characters. remainder: the clause without it, white space as one space. Keys should be distinct.
    whole: names of any length count, with any number of endings; without it, runs of more than INSIDE characters do not.

    An Aho-Corasick automaton of the names (a gazetteer, a list that a program or person keeps: it goes to each task) is walked once
    over a clause, so the cost does not depend on how many names there are; only clauses with a name make rows."""
    known = sorted({r.key for r in places.select("key").distinct().collect() if r.key and (whole or len(r.key) <= INSIDE)})
    numbers = ("place", "latitude", "longitude", "radius")

    def found(said: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ahocorasick.Automaton()
        for name in known:
            names.add_word(name, name)
        names.make_automaton()
        for batch in said:
            hits = [_longest(c, names, whole) if known and c else None for at in range(0, len(batch), TEXTS) for c in batch.slice(at, TEXTS).to_pylist()]
            yield pa.array([h and dict(zip(("at", "length", "keys"), h, strict=True)) for h in hits], pa.struct([("at", pa.int32()), ("length", pa.int32()), ("keys", pa.list_(pa.string()))]))

    run = F.arrow_udf(found, "at int, length int, keys array<string>")
    rows = clauses.select(key, column).withColumn("b", run(F.col(column))).where("b IS NOT NULL")
    named = rows.select(key, column, "b.at", "b.length", F.explode("b.keys").alias("key"))
    best = named.join(F.broadcast(places), "key").groupBy(key, column, "at", "length").agg(F.min(F.struct(*numbers)).alias("p"))
    left = F.concat(F.substring(F.col(column), F.lit(1), F.col("at") - 1), F.substring(F.col(column), F.col("at") + F.col("length"), F.length(column)))
    return best.select(key, "p.place", "at", "length", F.trim(F.regexp_replace(left, r"\s+", " ")).alias("remainder"), *(f"p.{n}" for n in numbers[1:]))


def validate(places: DataFrame) -> DataFrame:
    """(place, problem): coordinates or radius out of range, a box turned inside out (where the coordinates are right), and names of more than one place. Rows without a place or a name have no say in the last."""
    turned = geo.box(F.col("latitude"), F.col("longitude"), F.col("radius"))
    wrong = (("coordinates", ~geo.valid(F.col("latitude"), F.col("longitude"))), ("radius", ~F.coalesce((F.col("radius") > 0) & (F.col("radius") <= 2000), F.lit(False))), ("box", geo.valid(F.col("latitude"), F.col("longitude")) & F.coalesce((turned["south"] > turned["north"]) | (turned["west"] > turned["east"]), F.lit(False))))
    bad = places.select("place", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in wrong))).alias("p"))
    shared = places.groupBy("key").agg(F.min("place").alias("least"), F.max("place").alias("most")).where("least < most").select(F.col("key").alias("shared"))
    twice = places.where("place IS NOT NULL").join(shared, F.col("key") == F.col("shared")).select("place", F.concat(F.lit("name: "), "key").alias("problem"))
    return bad.select("place", F.explode("p").alias("problem")).unionByName(twice).distinct()


#: Smallest cell of the join of assets and places, in degrees; larger ones are this times powers of two.
CELL = 0.25


def _level(extent: Column) -> Column:
    """The smallest power of two by which a cell is as wide as an extent."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(CELL)) / CELL))).cast("int")


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / (F.pow(F.lit(2.0), level) * CELL)).cast("long")


def located(assets: DataFrame, places: DataFrame, wrap: bool = True, key: str = "asset_id", place: str = "place") -> DataFrame:
    """(place, key) of every asset in the box of every place. places: place, latitude, longitude, radius, any number of them.

    A range join on cells: a box goes under the cells, of the size of its own height and width, that it touches (four at most); an
    asset goes under its cell of each size that occurs (some hundred at most, whatever the tables); pairs that meet are checked.
    wrap: a box over the antimeridian is two strips; without it, it counts for all longitudes, as in `within`.
    Rows without a valid position give nothing; a place is one box for each distinct position and radius."""
    b = geo.box(F.col("latitude"), F.col("longitude"), F.col("radius"))
    whole = F.array(F.struct(*(b[k].alias(k) for k in ("south", "north", "west", "east"))))
    shape = geo.strips(F.col("latitude"), F.col("longitude"), F.col("radius")) if wrap else whole
    known = places.where(geo.valid(F.col("latitude"), F.col("longitude")) & (F.col("radius") >= 0)).select(place, "latitude", "longitude", "radius").distinct()
    boxes = known.select(F.col(place).alias("place"), F.inline(shape)).withColumns({"tall": _level(F.col("north") - F.col("south")), "wide": _level(F.col("east") - F.col("west"))})
    ends = {n: F.sequence(_cell(F.col(lo), F.col(level)), _cell(F.col(hi), F.col(level))) for n, lo, hi, level in (("row", "south", "north", "tall"), ("col", "west", "east", "wide"))}
    boxes = written(boxes.withColumn("row", F.explode(ends["row"])).withColumn("col", F.explode(ends["col"])), "boxes")
    sizes = boxes.select("tall", "wide").distinct()  # at most one row for each pair of powers of two up to the globe
    points = assets.where(geo.valid(F.col("latitude"), F.col("longitude"))).select(F.col(key).alias("id"), "latitude", "longitude").join(F.broadcast(sizes))
    points = points.select("id", "latitude", "longitude", "tall", "wide", _cell(F.col("latitude"), F.col("tall")).alias("row"), _cell(F.col("longitude"), F.col("wide")).alias("col"))
    met = points.join(boxes, ["tall", "wide", "row", "col"]).where(geo.inside(F.col("latitude"), F.col("longitude"), {k: F.col(k) for k in ("south", "north", "west", "east")}))
    return met.select(F.col("place").alias(place), F.col("id").alias(key))


def within(assets: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    return assets.where(geo.inside(F.col("latitude"), F.col("longitude"), geo.box(lat, lon, radius_km)))


def grid(assets: DataFrame, size: float = 0.02) -> DataFrame:
    """(cell_lat, cell_lon, n, representative): valid points by cell; the representative is the smallest id. Members are found by the same cell."""
    ok = assets.where(geo.valid(F.col("latitude"), F.col("longitude")))
    cells = ok.select(geo.cell(F.col("latitude"), size).alias("cell_lat"), geo.cell(F.col("longitude"), size).alias("cell_lon"), "asset_id")
    return cells.groupBy("cell_lat", "cell_lon").agg(F.count("*").alias("n"), F.min("asset_id").alias("representative"))


def grid_members(assets: DataFrame, size: float = 0.02) -> DataFrame:
    """(asset_id, representative): the cluster of every valid point; a list of a cluster's members, in order, is these rows sorted."""
    points = assets.where(geo.valid(F.col("latitude"), F.col("longitude"))).select("asset_id", geo.cell(F.col("latitude"), size).alias("cell_lat"), geo.cell(F.col("longitude"), size).alias("cell_lon"))
    return points.join(grid(assets, size), ["cell_lat", "cell_lon"]).select("asset_id", "representative")


def _merged(assets: DataFrame, most: int, size: float, inside: bool) -> tuple[DataFrame, DataFrame | None]:
    """(clusters, and with inside the cluster of each base cell's representative), both written."""
    points = assets.select(F.col("asset_id").alias("cluster"), "latitude", "longitude")
    rows = written(grid(assets, size).select(F.col("representative").alias("cluster"), "n").join(points, "cluster"), "clusters")
    owner = rows.select(F.col("cluster").alias("representative"), "cluster") if inside else None
    while rows.count() > most and size < 360:
        size *= 2
        cells = [geo.cell(F.col(c), size).alias(f"_{c}") for c in ("latitude", "longitude")]
        placed = rows.select("*", *cells)
        first = F.struct("latitude", "longitude")
        rows = placed.groupBy("_latitude", "_longitude").agg(F.min("cluster").alias("c"), F.sum("n").alias("n"), F.min_by(first, "cluster").alias("at"))
        rows = written(rows.select(F.col("c").alias("cluster"), "n", "at.latitude", "at.longitude"), "clusters")
        if inside:
            now = rows.select(F.col("cluster").alias("now"), *(geo.cell(F.col(c), size).alias(f"_{c}") for c in ("latitude", "longitude")))
            moved = placed.select("cluster", "_latitude", "_longitude").join(now, ["_latitude", "_longitude"]).select("cluster", "now")
            owner = written(owner.join(moved, "cluster").select("representative", F.col("now").alias("cluster")), "cluster-owner")
    return rows, owner


def clusters(assets: DataFrame, most: int = 400, size: float = 0.02) -> DataFrame:
    """(cluster, n, latitude, longitude): a grid whose cells double until there are at most `most`; each merges cells by the place of its representative.

    The loop is over grouped tables and takes a count to the driver each time: 15 rounds at most, as the world is 360 degrees wide."""
    return _merged(assets, most, size, False)[0]


def cluster_members(assets: DataFrame, most: int = 400, size: float = 0.02) -> DataFrame:
    """(asset_id, cluster): the cluster of clusters() that every valid point is in. Base cells keep their cluster through the rounds, so a point is looked up once, by its cell."""
    owner = _merged(assets, most, size, True)[1]
    return grid_members(assets, size).join(owner, "representative").select("asset_id", "cluster")
