"""What the registered queries share: feeds, and one staged publication per data folder."""

from functools import cached_property
import uuid

from pyspark.sql import DataFrame, SparkSession

from conformance.feed_map import OrderFeed
from headwise.operators import observed, schedule
from headwise.operators.staging import FeedChoice, ObservedChoice, Staging
from headwise.plans.publish import Publication
from headwise.sources.store import Stage, lazily, shared_root

CHOICES = (FeedChoice(), ObservedChoice(scope="fixture"))


class Context:
    def __init__(self, spark: SparkSession, sf_dir: str, staged: bool = True):
        self.spark, self.sf_dir = spark, sf_dir
        self.feed = OrderFeed(spark, sf_dir)
        self.archive_feed = OrderFeed(spark, sf_dir, historic=True)
        self.root = f"{shared_root(spark)}/headwise-{uuid.uuid4().hex}"
        self.cut = Stage(spark, self.root) if staged else lazily
        self._feeds: dict[str, dict[str, DataFrame]] = {}

    @cached_property
    def publication(self) -> Publication:
        return Publication(self.feed.raw(), *CHOICES, cut=self.cut)

    @cached_property
    def historic_staging(self) -> Staging:
        scope = "regional_historic"
        return Staging(self.archive_feed.raw(), FeedChoice(scope=scope), ObservedChoice(scope=scope))

    @cached_property
    def days(self) -> DataFrame:
        p = self.publication
        return schedule.trip_days(p.scheduled_trips, p.service_dates)

    @cached_property
    def key_counts(self) -> DataFrame:
        return observed.observation_key_count(self.publication.stop_observations)

    def staged_feed(self, name: str, build) -> dict[str, DataFrame]:
        if name not in self._feeds:
            self._feeds[name] = {t: self.cut(f"{name}_{t}", df) for t, df in build().items()}
        return self._feeds[name]

    def folder(self, name: str) -> str:
        """A new place for files that a query writes and reads back."""
        return f"{self.root}/files-{uuid.uuid4().hex}/{name}"


_contexts: dict[tuple, Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    """Relations needed by many queries are written once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _contexts:
        _contexts[key] = Context(spark, sf_dir)
    return _contexts[key]
