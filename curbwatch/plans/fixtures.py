"""Typed views over the warehouse tables, shaped like the domain's own inputs.

Every view is a projection or a join of the given tables, so its size grows with
them. The newest poll's time is read once, and tables that many views share are
written once to the checkpoint folder; both are kept by application and folder.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.corridor import corridor
from ..operators.floors import incident_cameras
from ..operators.scale import durable, with_halo

ID_CHUNK = 100_000
_CLOCK: dict[tuple, float] = {}
_KEPT: dict[tuple, DataFrame] = {}


def epoch(ts: str) -> Column:
    """Seconds since 1970 of a zone-free timestamp."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ)) / 1E6D")


class Fixtures:
    """Lazily built views for one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def kept(self, name: str, build) -> DataFrame:
        """A derived table written once per session and folder through the checkpoint folder."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _KEPT:
            _KEPT[key] = durable(build())
        return _KEPT[key]

    @cached_property
    def region(self) -> DataFrame:
        """One city per nation; at most a few hundred rows whatever the scale."""
        n = self.table("nation")
        lat = 30.0 + (F.col("n_nationkey") % 5) * 3.0
        lon = -120.0 + F.floor(F.col("n_nationkey") / 5.0) * 8.0
        return n.select(F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("name"),
                        F.col("n_regionkey").alias("source_id"), lat.alias("lat"), lon.cast("double").alias("lon"))

    @cached_property
    def camera(self) -> DataFrame:
        c = self.table("customer")
        # The nation table is a fixed list, so broadcasting it is bounded.
        r = F.broadcast(self.region.select("region_id", "source_id", F.col("lat").alias("rlat"), F.col("lon").alias("rlon")))
        k = F.col("c_custkey")
        roadway = (F.when(k % 4 == 0, F.concat(F.lit("I-"), ((k % 9) * 10 + 5).cast("string"), F.lit("/US 51")))
                   .when(k % 4 == 1, "US 12/18").when(k % 4 == 2, "IA 5").otherwise("Main St"))
        highway = (F.when(F.col("c_mktsegment") == "BUILDING", "motorway")
                   .when(F.col("c_mktsegment") == "AUTOMOBILE", "motorway_link")
                   .when(F.col("c_mktsegment") == "MACHINERY", "primary")
                   .when(F.col("c_mktsegment") == "HOUSEHOLD", "residential").otherwise("tertiary"))
        return (c.join(r, c.c_nationkey == r.region_id)
                .select(k.alias("camera_id"), "region_id", "source_id",
                        (F.col("rlat") + ((k * 37) % 100 - 50) * 0.001).alias("lat"),
                        (F.col("rlon") + ((k * 91) % 100 - 50) * 0.001).alias("lon"),
                        roadway.alias("roadway"), F.col("c_name").alias("location"), highway.alias("highway"),
                        F.when(k % 5 != 0, k % 5).alias("lanes"), (k % 2 == 0).alias("two_way"),
                        (40 + (k % 8) * 10).cast("double").alias("speed_kmh"),
                        F.when(F.col("c_acctbal") > 5000, F.floor(F.col("c_acctbal") * 15.0)).alias("aadt")))

    @cached_property
    def poll(self) -> DataFrame:
        e = self.table("events")
        i = F.col("event_id")
        result = (F.when(i % 10 == 0, "unavailable").when(i % 10 == 1, "not_modified")
                  .when(i % 10 == 2, "unchanged").otherwise("fresh"))
        return e.select(i.alias("poll_id"), F.col("user_id").alias("camera_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
                        epoch("ts").alias("at"), (F.col("value") / 3000.0).alias("diff"),
                        ((i * 7919 % 1000) / 1000.0).alias("brightness"), result.alias("result"))

    @cached_property
    def poll_dense(self) -> DataFrame:
        return self.poll.withColumn("camera_id", F.col("camera_id") % 8)

    @cached_property
    def fresh(self) -> DataFrame:
        return self.poll.filter(F.col("result") == "fresh")

    @cached_property
    def fresh_dense(self) -> DataFrame:
        return self.poll_dense.filter(F.col("result") == "fresh")

    @cached_property
    def now(self) -> Column:
        """The newest poll's time as a literal, so that age filters reach the scan."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _CLOCK:
            _CLOCK[key] = self.table("events").agg(F.max(epoch("ts"))).first()[0]
        return F.lit(_CLOCK[key])

    @cached_property
    def incident(self) -> DataFrame:
        e = self.table("events").filter(F.col("event_type") == "error")
        i = F.col("event_id")
        r = F.broadcast(self.region.select("region_id", F.col("lat").alias("rlat"), F.col("lon").alias("rlon")))
        return (e.withColumn("region_id", (i % 25).cast("int")).join(r, "region_id")
                .select(i.alias("incident_id"), "region_id",
                        F.concat(F.lit("T"), (i % 6).cast("string")).alias("type"),
                        F.concat(F.lit("MILE "), (i % 200).cast("string")).alias("location"),
                        F.when(i % 4 != 3, F.concat(F.lit("NOTE "), (i % 11).cast("string"))).alias("remarks"),
                        epoch("ts").alias("reported_at"),
                        (F.col("rlat") + ((i * 53) % 100 - 50) * 0.001).alias("lat"),
                        (F.col("rlon") + ((i * 71) % 100 - 50) * 0.001).alias("lon"),
                        (i % 3 != 0).alias("road_relevant"), (i % 7 == 0).alias("implies_closure")))

    @cached_property
    def edge(self) -> DataFrame:
        """Directed chain of sites per city, one site per camera."""
        # The next camera of a city is found chunk by chunk of the id space, one halo row across each border.
        chunked = self.camera.select("camera_id", "region_id", F.floor(F.col("camera_id") / ID_CHUNK).alias("chunk"))
        w = Window.partitionBy("region_id", "chunk").orderBy("camera_id")
        nxt = (with_halo(chunked, ["region_id"], "chunk", ["camera_id"], 1)
               .withColumn("src", F.lag("camera_id").over(w)).filter(~F.col("_halo"))
               .select("src", F.col("camera_id").alias("dst"), "region_id"))
        k = F.col("src")
        kind = F.when(k % 7 == 0, "nearby").when(k % 3 == 0, "freeway").when(k % 3 == 1, "street").otherwise("ramp")
        return (nxt.filter(k.isNotNull())
                .select("src", "dst", "region_id", kind.alias("kind"),
                        (200 + (k * 53) % 1800).cast("double").alias("length_m"),
                        (20 + (k * 31) % 90).cast("double").alias("tt_s")))

    @cached_property
    def thumb(self) -> DataFrame:
        """Sixty-four gray values per picture, ten cameras, in picture order."""
        e = self.table("embeddings")
        px = F.transform("embedding", lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v.cast("double") * 0.5 + 0.5)))
        return e.select(F.col("label").cast("bigint").alias("camera_id"), F.col("vec_id").alias("seq"), px.alias("thumb"))

    @cached_property
    def vote(self) -> DataFrame:
        """Pairwise choices with eight features a side."""
        o = self.table("orders")
        k = F.col("o_orderkey")

        def side(p: int) -> Column:
            return F.array(*[((k * (31 + 2 * f) + p * 17 + f * 7) % 101) / 100.0 for f in range(8)])

        cam = F.col("o_custkey")
        has_look = k % 3 != 0
        return o.select(
            k.alias("vote_id"), epoch("o_orderdate").alias("ts"), (k % 40).alias("voter"),
            cam.alias("a_id"), ((cam + 1 + k % 13)).alias("b_id"),
            ((k * 7) % 101 / 100.0).alias("a_attention"), ((k * 11 + 3) % 101 / 100.0).alias("b_attention"),
            ((k * 13) % 101 / 100.0).alias("a_equation"), ((k * 17 + 5) % 101 / 100.0).alias("b_equation"),
            F.when(has_look, (k * 5 % 7) / 2.0).alias("a_level"), F.when(has_look, ((k * 3 + 1) % 7) / 2.0).alias("b_level"),
            F.when(has_look, (k % 10) / 10.0).alias("a_confidence"), F.when(has_look, ((k + 4) % 10) / 10.0).alias("b_confidence"),
            F.when(has_look, (k % 50).cast("double")).alias("a_look_at"),
            F.when(has_look, F.when(k % 4 == 0, (k % 49)).otherwise(k % 50).cast("double")).alias("b_look_at"),
            side(1).alias("a_x"), side(2).alias("b_x"),
            F.when(F.col("o_orderstatus") == "O", "a").otherwise("b").alias("pick"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "evaluate").otherwise("learn").alias("mode"),
            F.when(k % 2 == 0, "random").otherwise("disagree").alias("stratum"))

    @cached_property
    def links(self) -> DataFrame:
        """Cameras each incident names, kept as a table because a scoring pass reads it several times."""
        return self.kept("links", lambda: incident_cameras(self.incident, self.camera))

    @cached_property
    def site_camera(self) -> DataFrame:
        k = F.col("camera_id")
        return self.camera.select(k.alias("site_id"), k, (k % 3 == 0).alias("has_video"), k.alias("ordinal"),
                                  (F.col("highway") == "motorway").alias("is_freeway"))

    @cached_property
    def corridor(self) -> DataFrame:
        """Neighbors of every camera, kept as a table like the graph it comes from."""
        return self.kept("corridor", lambda: corridor(self.edge, self.site_camera.select("site_id", "camera_id")))

    @cached_property
    def verdict(self) -> DataFrame:
        """One arbiter answer per incident that has one; some name a camera, some an upstream neighbor."""
        i = F.col("incident_id")
        first = self.links.filter(F.col("rank") == 1).select("incident_id", F.col("camera_id").alias("first_id"))
        up = self.edge.select(F.col("dst").alias("first_id"), F.col("src").alias("up_id"))
        n = self.incident.filter(i % 4 != 0).join(first, "incident_id", "left").join(up, "first_id", "left")
        chosen = F.when(i % 5 == 0, None).when(i % 5 < 3, F.col("first_id")).otherwise(F.coalesce("up_id", "first_id"))
        return n.select(
            "incident_id", F.when(i % 9 == 0, F.lit("T9")).otherwise(F.col("type")).alias("type"),
            "reported_at", "location", F.when(i % 13 == 0, F.lit("NOTE OLD")).otherwise(F.col("remarks")).alias("remarks"), (F.col("reported_at") + (i % 600)).alias("at"),
            ((i * 7) % 100 / 100.0).alias("supported"), ((i * 11) % 100 / 100.0).alias("cleared"),
            ((i * 13) % 41 / 10.0).alias("score"), F.lit(5).alias("levels"), ((i * 17) % 100 / 100.0).alias("score_confidence"),
            chosen.alias("chosen"), ((i * 19) % 100 / 100.0).alias("chosen_confidence"))

    @cached_property
    def reading(self) -> DataFrame:
        """Gate and review answers per camera over time."""
        p = self.poll.filter(F.col("poll_id") % 5 == 1)
        i = F.col("poll_id")
        return p.select("camera_id", i.alias("reading_id"), F.col("at").alias("read_at"),
                        ((i * 23) % 100 / 100.0).alias("standstill"), ((i * 29) % 41 / 10.0).alias("level"),
                        F.when(i % 11 == 0, 1).otherwise(5).alias("levels"), ((i * 31) % 100 / 100.0).alias("confidence"))

    @cached_property
    def vehicle_count(self) -> DataFrame:
        """Detector counts for some fresh frames."""
        p = self.fresh.filter(F.col("poll_id") % 3 == 0)
        i = F.col("poll_id")
        by = F.create_map(F.lit("car"), (i % 5).cast("int"), F.lit("truck"), (i % 3).cast("int"), F.lit("bus"), (i % 2).cast("int"))
        return p.select("camera_id", F.col("at").alias("frame_at"), (i % 5 + i % 3 + i % 2).alias("vehicles"), by.alias("by_class"))

    @cached_property
    def segment(self) -> DataFrame:
        """A short road by every camera and a crossing decoy."""
        k = F.col("camera_id")
        base = self.camera.select("camera_id", "region_id", "lat", "lon", "highway")
        own = base.select((k * 2).alias("way_id"), "region_id",
                          (F.col("lat") - 0.0012).alias("a_lat"), (F.col("lon") + ((k % 7) - 3) * 0.0001).alias("a_lon"),
                          (F.col("lat") + 0.0012).alias("b_lat"), (F.col("lon") + ((k % 7) - 3) * 0.0001).alias("b_lon"),
                          "highway", F.when(k % 3 != 0, F.concat(F.lit("US "), F.when(k % 2 == 0, "12").otherwise("51"))).alias("ref"),
                          (k % 2 == 0).alias("two_way"))
        cross = base.select((k * 2 + 1).alias("way_id"), "region_id",
                            (F.col("lat") + ((k % 5) - 2) * 0.0001).alias("a_lat"), (F.col("lon") - 0.001).alias("a_lon"),
                            (F.col("lat") + ((k % 5) - 2) * 0.0001).alias("b_lat"), (F.col("lon") + 0.001).alias("b_lon"),
                            F.lit("residential").alias("highway"), F.when(k % 4 == 0, "IA 5").alias("ref"),
                            F.lit(True).alias("two_way"))
        return own.unionByName(cross)

    @cached_property
    def state_polygon(self) -> DataFrame:
        """One square state with a square hole per region, as rings of lon-lat points."""
        lat, lon = F.col("lat"), F.col("lon")

        def ring(h: float) -> Column:
            pts = [(-h, -h), (-h, h), (h, h), (h, -h)]
            return F.array(*[F.struct((lon + a).alias("x"), (lat + b).alias("y")) for a, b in pts])

        return self.region.select(F.col("region_id").alias("state_id"), "source_id", F.array(ring(0.04), ring(0.01)).alias("rings"),
                                  lon.alias("center_x"), lat.alias("center_y"))
