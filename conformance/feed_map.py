"""Transit tables derived from the order tables, so that every operator can run on them.

Orders are trips, customers' nations are routes, line items are stops and their
observations. All rules are integer arithmetic on keys; they plant every case the
operators distinguish: missing directions, blank arrivals, stray and repeated
observations, times a day off, stale snapshots, removed service days, absent routes.
`oracle.py` states the same rules in SQL.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from headwise.functions.columns import elapsed_instant, shift_secs

FIRST_DAY = "2001-01-01"


def col(expr: str) -> Column:
    return F.expr(expr)


def _clock(secs: str) -> Column:
    parts = [f"({secs}) div 3600", f"(({secs}) div 60) % 60", f"({secs}) % 60"]
    return F.concat_ws(":", *[F.lpad(col(p).cast("string"), 2, "0") for p in parts])


class OrderFeed:
    """`historic=False` gives the current feed, `True` the same trips as a regional archive."""

    def __init__(self, spark: SparkSession, sf_dir: str, historic: bool = False):
        self.spark, self.dir, self.historic = spark, sf_dir, historic
        self.scope = "regional_historic" if historic else "operator_active"
        self.label = "hist_v1" if historic else "feed_v2"

    def table(self, name: str, *columns: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet").select(*columns)

    def _meta(self, df: DataFrame, scope: str, label: Column, loaded: Column | None = None):
        loaded = F.lit("2001-02-02") if loaded is None else loaded
        return df.withColumns(
            {
                "source_system": F.lit("orders"),
                "feed_scope": F.lit(scope),
                "operator_id": F.lit("OP"),
                "snapshot_label": label,
                "ingested_at": loaded.cast("timestamp"),
            }
        )

    def _feed_meta(self, df: DataFrame) -> DataFrame:
        return self._meta(df, self.scope, F.lit(self.label))

    @property
    def nations(self) -> DataFrame:
        n = self.table("nation", "n_nationkey", "n_name", "n_regionkey")
        return n.select(
            F.col("n_nationkey").alias("route"), "n_name",
            col("CASE WHEN n_regionkey < 3 THEN 'SF' ELSE 'OT' END").alias("agency"),
        )

    @property
    def trip_base(self) -> DataFrame:
        orders = self.table("orders", "o_orderkey", "o_custkey")
        homes = self.table("customer", "c_custkey", "c_nationkey")
        return (
            orders.join(homes, orders.o_custkey == homes.c_custkey)
            .select(
                F.col("o_orderkey").alias("k"),
                F.col("c_nationkey").alias("route"),
                col("CASE WHEN o_orderkey % 97 = 0 THEN 9 ELSE o_custkey % 2 END").cast("int").alias("dir"),
                col("cast(o_orderkey % 14 as int)").alias("d"),
                col("18000 + (o_orderkey * 37) % 72000").alias("start_secs"),
            )
            .join(self.nations.select("route", "agency"), "route")
            .withColumn("service_date", col(f"date_add(date'{FIRST_DAY}', d)"))
            .withColumn("trip_id", self._trip_id())
        )

    def _trip_id(self) -> Column:
        if not self.historic:
            return col("cast(k as string)")
        # Every fifth trip carries the date of the day after.
        dated = "date_format(date_add(service_date, if(k % 5 = 0, 1, 0)), 'yyyyMMdd')"
        return col(f"concat(agency, ':', cast(k as string), ':', {dated})")

    def _prefixed(self, expr: str) -> Column:
        return col(f"concat(agency, ':', {expr})" if self.historic else expr)

    @property
    def stop_base(self) -> DataFrame:
        """One row per order and line number, renumbered without gaps."""
        lines = self.table("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        slots = lines.groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk")
        )
        # At most one row per line number is left in an order.
        place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
        return (
            slots.withColumn("seq", place)
            .join(self.trip_base, F.col("l_orderkey") == F.col("k"))
            .withColumn("at", col("start_secs + (seq - 1) * 300"))
            .withColumn("stop_id", col("concat('S', route, '_', dir, '_', seq)"))
        )

    def routes(self) -> DataFrame:
        rows = self.nations.filter("route <> 24").select(
            self._prefixed("cast(route as string)").alias("route_id"),
            F.col("agency").alias("agency_id"),
            F.col("n_name").alias("route_short_name"),
            col("CASE WHEN route % 4 = 0 THEN '' ELSE concat(n_name, ' Line') END").alias("route_long_name"),
            F.lit("3").alias("route_type"),
            F.lit("").alias("route_color"),
            F.lit("FFFFFF").alias("route_text_color"),
        )
        if self.historic:
            return self._feed_meta(rows)
        old = rows.withColumn("route_long_name", F.lit("Old name"))
        return self._feed_meta(rows).unionByName(
            self._meta(old, self.scope, F.lit("feed_v1"), F.lit("2001-02-01"))
        )

    def trips(self) -> DataFrame:
        blank_shape = "k % 2 = 0" if self.historic else "k % 53 = 0"
        return self._feed_meta(
            self.trip_base.select(
                self._prefixed("cast(route as string)").alias("route_id"),
                col("concat('V', route, '_', d)").alias("service_id"),
                "trip_id",
                col(
                    "CASE WHEN route % 6 = 5 THEN '' WHEN k % 10 = 0 THEN 'Short turn'"
                    " ELSE concat('To ', dir) END"
                ).alias("trip_headsign"),
                col("CASE WHEN dir = 9 THEN '' ELSE cast(dir as string) END").alias("direction_id"),
                col(f"CASE WHEN {blank_shape} THEN '' ELSE concat('SH', route, '_', dir) END").alias("shape_id"),
            )
        )

    def stop_times(self) -> DataFrame:
        return self._feed_meta(
            self.stop_base.select(
                "trip_id",
                F.when(F.col("pk") % 61 == 0, "").otherwise(_clock("at")).alias("arrival_time"),
                _clock("at + 20").alias("departure_time"),
                "stop_id",
                F.col("seq").cast("string").alias("stop_sequence"),
                col("CASE WHEN route % 7 = 3 THEN '' ELSE cast(seq - 1 as string) END").alias("shape_dist_traveled"),
            )
        )

    @property
    def _places(self) -> DataFrame:
        places = self.stop_base.select("route", "dir", "seq", "stop_id").distinct()
        return places.withColumns(
            {
                "lat_micro": col("700000 + route * 3000 + seq * 1500 + dir * 100 + (seq * seq % 5) * 200"),
                "lon_micro": col("400000 + route * 2000 + seq * 2500 + dir * 300"),
            }
        )

    @staticmethod
    def _degrees(whole: str, micro: str) -> Column:
        return F.concat(F.lit(f"{whole}."), F.lpad(col(micro).cast("string"), 6, "0"))

    def stops(self) -> DataFrame:
        blank = (F.col("route") * 3 + F.col("seq")) % 29 == 0
        return self._feed_meta(
            self._places.select(
                "stop_id",
                col(
                    "CASE WHEN (route + seq) % 17 = 0 THEN ''"
                    " ELSE concat('Stop ', route, ' ', dir, ' ', seq) END"
                ).alias("stop_name"),
                F.when(blank, "").otherwise(self._degrees("37", "lat_micro")).alias("stop_lat"),
                F.when(blank, "").otherwise(self._degrees("-122", "lon_micro")).alias("stop_lon"),
            )
        )

    def shapes(self) -> DataFrame:
        points = self._places.select(
            "*", F.explode(F.array(F.lit(0), F.lit(1))).alias("mid")
        )
        return self._feed_meta(
            points.select(
                col("concat('SH', route, '_', dir)").alias("shape_id"),
                self._degrees("37", "lat_micro + mid * 700").alias("shape_pt_lat"),
                self._degrees("-122", "lon_micro + mid * 900").alias("shape_pt_lon"),
                col("cast(seq * 2 - 1 + mid as string)").alias("shape_pt_sequence"),
                col(
                    "CASE WHEN route % 7 = 3 THEN ''"
                    " ELSE concat(seq - 1, if(mid = 1, '.5', '')) END"
                ).alias("shape_dist_traveled"),
            )
        )

    @property
    def _services(self) -> DataFrame:
        return self.nations.select(
            "route", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("d")
        ).withColumn("service_id", col("concat('V', route, '_', d)"))

    def calendar(self) -> DataFrame:
        days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
        return self._feed_meta(
            self._services.select(
                "service_id",
                *[F.when(F.col("d") % 7 == i, "1").otherwise("0").alias(n) for i, n in enumerate(days)],
                col("if(d < 7, '20010101', '20010108')").alias("start_date"),
                col("if(d < 7, '20010107', '20010114')").alias("end_date"),
            )
        )

    def calendar_dates(self) -> DataFrame:
        changes = F.expr(
            "filter(array("
            " named_struct('on', d = 0, 'date', '20010115', 'kind', '1'),"
            " named_struct('on', d = 13 and route % 5 = 0, 'date', '20010114', 'kind', '2'),"
            " named_struct('on', d = 6, 'date', '20010116', 'kind', '1'),"
            " named_struct('on', d = 6, 'date', '20010116', 'kind', '2')), c -> c.on)"
        )
        return self._feed_meta(
            self._services.select("service_id", F.explode(changes).alias("c")).select(
                "service_id", F.col("c.date").alias("date"), F.col("c.kind").alias("exception_type")
            )
        )

    @property
    def _seen(self) -> DataFrame:
        """Stops with an observation: some dropped, some naming a wrong stop, slot or trip."""
        wrong_trip = (
            "if(pk % 13 = 0, cast(k as string), trip_id)" if self.historic else "cast(-k as string)"
        )
        return self.stop_base.filter("pk % 11 <> 0").select(
            "route", "agency", "service_date", "pk", "sk", "k",
            col(f"if(pk % 50 = 0, {wrong_trip}, trip_id)" if not self.historic else wrong_trip).alias("trip_id"),
            col("if(sk % 20 = 0, 'WRONG', stop_id)").alias("stop_id"),
            col("if(pk % 41 = 0, 99, seq)").alias("stop_sequence"),
            col("at + pk % 600 - 60").alias("secs"),
        )

    def stop_observations(self) -> DataFrame:
        scope = "regional_historic" if self.historic else "fixture"
        copies = F.expr(
            "filter(array(named_struct('on', true, 'v', 2), named_struct('on', sk % 25 = 7, 'v', 2),"
            " named_struct('on', pk % 20 = 3, 'v', 1)), c -> c.on)"
        )
        rows = self._seen.withColumn("copy", F.explode(copies))
        shifted = elapsed_instant(F.col("service_date"), F.col("secs"))
        shifted = (
            F.when(F.col("pk") % 29 == 0, shift_secs(shifted, -86_400))
            .when(F.col("pk") % 31 == 0, shift_secs(shifted, 86_400))
            .otherwise(shifted)
        )
        label = F.concat(F.lit("obs_v"), F.col("copy.v"))
        loaded = F.concat(F.lit("2001-02-0"), F.col("copy.v"))
        out = rows.select(
            "service_date", "trip_id", "stop_id", "stop_sequence",
            _clock("secs").alias("observed_arrival_time"),
            shifted.alias("observed_arrival_ts"),
            label.alias("snapshot_label"), loaded.alias("_loaded"),
        )
        return self._meta(out, scope, F.col("snapshot_label"), F.col("_loaded")).drop("_loaded")

    def archive_observations(self) -> DataFrame:
        """Observation file rows in the archive layout; some without an observed time."""
        return self._seen.select(
            F.date_format("service_date", "yyyyMMdd").alias("service_date"),
            "trip_id",
            F.col("stop_sequence").cast("string").alias("stop_sequence"),
            F.col("stop_id").alias("to_stop_id"),
            F.when(F.col("pk") % 23 == 0, "").otherwise(_clock("secs")).alias("observed_arrival_time"),
            col("if(pk % 3 = 0, agency, '')").alias("agency_id"),
            col("if(pk % 3 = 1, concat(agency, ':', route), '')" if self.historic
                else "if(pk % 3 = 1, cast(route as string), '')").alias("route_id"),
        )

    def lane_overlays(self) -> DataFrame:
        """One lane per nation along its first stops: on them, 11 m or 110 m beside them."""
        beside = "CASE route % 3 WHEN 0 THEN 0 WHEN 1 THEN 100 ELSE 1000 END"

        def at(seq):
            lat = f"700000 + route * 3000 + {seq} * 1500 + ({seq} * {seq} % 5) * 200 + {beside}"
            lon = f"400000 + route * 2000 + {seq} * 2500"
            return F.concat(
                F.lit("["), self._degrees("-122", lon), F.lit(","), self._degrees("37", lat), F.lit("]")
            )

        geometry = F.concat(
            F.lit('{"type":"LineString","coordinates":['), at(1), F.lit(","), at(2), F.lit("]}")
        )
        rows = self.nations.select(
            "route",
            col("concat('lane_', route)").alias("overlay_id"),
            F.col("n_name").alias("street_name"),
            col("concat('Lane ', route)").alias("segment_name"),
            col("if(route % 4 = 1, '', cast(route as string))").alias("route_hint"),
            geometry.alias("geom_geojson"),
        )
        new = self._meta(rows, "overlay", F.lit("lanes_v2"))
        old = self._meta(rows.filter("route % 2 = 0"), "overlay", F.lit("lanes_v1"), F.lit("2001-02-01"))
        return new.unionByName(old).drop("route")

    def raw(self) -> dict[str, DataFrame]:
        names = [
            "routes", "trips", "stops", "stop_times", "shapes", "calendar", "calendar_dates",
            "stop_observations", "lane_overlays",
        ]
        return {n: getattr(self, n)() for n in names}

    def archive(self) -> dict[str, DataFrame]:
        """The schedule and archive-layout observations as plain text tables."""
        names = ["routes", "trips", "stops", "stop_times", "shapes", "calendar", "calendar_dates"]
        meta = ["source_system", "feed_scope", "operator_id", "snapshot_label", "ingested_at"]
        feed = {n: getattr(self, n)().drop(*meta) for n in names}
        feed["stop_observations"] = self.archive_observations()
        return feed
