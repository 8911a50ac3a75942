"""The five stages over a return panel, each a table keyed by window."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora import config as C
from tremora.operators import community, composite, direction, inference, nulls, pairs, quality, selection, sparse, stress, volatility
from tremora.operators import graph as G
from tremora.operators import panel as P
from tremora.session import global_rank, materialize, values
from tremora.sources import daily as S
from tremora.sources.store import StageStore, require_windows


@dataclass
class Settings:
    n_assets: int | None = None
    method: str = "both"
    alpha: float = C.ALPHA
    tau: float = C.TAU
    floor: float = C.GRANGER_FLOOR
    lag: int = C.LAG
    granger_lag: int = C.GRANGER_LAG
    n_controls: int = C.N_CONTROLS
    lambdas: list = field(default_factory=sparse.lambda_grid)
    early_stop: bool = False
    min_assets: int = C.MIN_ASSETS
    min_rows: int = C.MIN_ROWS
    mle_min_rows: int = C.ADCC_MIN_ROWS
    n_er_sims: int = C.N_ER_SIMS
    n_rewires: int = C.N_REWIRES
    n_er_matched: int = C.N_ER_MATCHED
    motifs: bool = True
    every_window: bool = False


def build_panel(spark: SparkSession, daily_path: str, names_path: str, delisting_path: str,
                start: str = "1985-01-01", end: str = "2024-12-31", membership: DataFrame | None = None):
    """Raw files to ``(info, prices, returns, calendar)``, all long.

    ``membership`` optionally restricts rows to the spells of index members.
    """
    rows = S.daily(spark, daily_path, start, end)
    if membership is not None:
        m = membership.select("permno", "start", "ending")
        rows = rows.join(m, "permno").where("date BETWEEN start AND ending").drop("start", "ending").dropDuplicates(["permno", "date"])
    names = S.csv(spark, names_path, S.NAMES)
    over = values(spark, list(C.TICKER_OVERRIDES.items()), ["permno", "ticker"], ["BIGINT", "STRING"])
    label = P.latest_names(names, over)
    bands = values(spark, C.SECTOR_BANDS, ["lo", "hi", "sector"], ["INT", "INT", "STRING"])
    info = P.sector_of(label, bands, "siccd").select("asset", F.col("comnam").alias("security"), "sector", "permno")
    cal = P.calendar(rows)
    key = info.select("permno", "asset")
    simple = rows.where("ret IS NOT NULL").join(key, "permno").select("asset", "date", "ret")
    gone = S.csv(spark, delisting_path, S.DELISTING).join(key, "permno").select("asset", "dlstdt", "dlret")
    spliced = P.splice_delisting(simple, gone, cal, start, end)
    returns = P.simple_to_log(spliced).join(cal.select("date", "pos"), "date").select("asset", "date", "pos", "x")
    prices = P.split_adjusted(rows).join(key, "permno").select("asset", "date", "price")
    common = prices.select("asset").intersect(returns.select("asset"))
    return info.join(common, "asset", "left_semi"), P.keep_assets(prices, common), P.keep_assets(returns, common), cal


class StressPipeline:
    """Stages as methods; results are plain DataFrames backed by stage tables.

    ``returns`` is ``(asset, date, pos, x)`` with integer or string assets,
    ``snapshots`` ``(snapshot, start, end, regime)``, ``sectors`` ``(asset, sector)``.
    ``previous`` are pooled parameters of an earlier run: where the new ones hardly
    differ they stay in force, so window correlations need not change.
    """

    def __init__(self, spark: SparkSession, returns: DataFrame, calendar: DataFrame, snapshots: DataFrame,
                 sectors: DataFrame, adv: DataFrame | None = None, settings: Settings | None = None,
                 store: StageStore | None = None, previous: DataFrame | None = None):
        self.spark, self.cal, self.snapshots, self.store, self.previous = spark, calendar, snapshots, store, previous
        self.set = settings or Settings()
        self._tables: dict[str, DataFrame] = {}
        if self.set.n_assets:
            returns = P.keep_assets(returns, selection.top_by(P.coverage(returns, "x"), self.set.n_assets, "n_obs"))
        # graphs use integer nodes: rank of the asset label
        ids = returns.select("asset").distinct()
        self.ids = self._table("ids", lambda: global_rank(ids, "asset", name="node").withColumn("node", F.col("node").cast("bigint")))
        swap = lambda df: df.join(self.ids, "asset").drop("asset").withColumnRenamed("node", "asset")
        self.returns = self._table("returns", lambda: swap(returns).select("asset", "date", "pos", "x"))
        self.sectors, self.adv = swap(sectors), swap(adv) if adv is not None else None

    def _table(self, name, build) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = (self.store.get(name, asdict(self.set), build) if self.store else materialize(build(), name))
        return self._tables[name]

    # stage 1
    def volatility(self) -> DataFrame:
        return self._table("volatility", lambda: volatility.garch(volatility.series_of(self.returns)))

    def residuals(self) -> DataFrame:
        return self._table("residuals", lambda: volatility.residuals(self.volatility()))

    def parameters(self) -> DataFrame:
        return self._table("parameters", lambda: self.settled(composite.fit(self.residuals(), min_rows=self.set.mle_min_rows), self.previous))

    @staticmethod
    def settled(new: DataFrame, previous: DataFrame | None) -> DataFrame:
        return new if previous is None or volatility.refit_needed(new, previous) else previous

    def residual_windows(self) -> DataFrame:
        def build():
            t = P.complete_cases(self.residuals(), self.snapshots, self.cal, "z", min_rows=self.set.min_rows, min_assets=self.set.min_assets)
            return require_windows(materialize(t, "windows"), self.snapshots) if self.set.every_window else t

        return self._table("residual_windows", build)

    def _guarded(self) -> DataFrame:
        return pairs.guarded_windows(pairs.vectors(self.residual_windows(), "z"), self.parameters())

    def correlations(self) -> DataFrame:
        return self._table("correlations", lambda: pairs.pair_values(self._guarded(), pairs.adcc_block, extra=["a", "b", "g"]))

    def nodes(self) -> DataFrame:
        return self._table("nodes", lambda: self.residual_windows().select("snapshot", F.col("asset").alias("node")).distinct())

    # stage 2
    def sparse(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        if "edges" not in self._tables:
            got = sparse.sparse_network(self.correlations(), self.residual_windows(), self.set.lambdas, self.set.early_stop)
            for name, df in zip(("edges", "selection", "grid"), got):
                self._table(name, lambda df=df: df)
        return self._tables["edges"], self._tables["selection"], self._tables["grid"]

    # stage 3: tests on raw returns, balanced over the members of each window
    def decisions(self) -> DataFrame:
        def build():
            s = self.set
            rows = P.in_windows(self.returns, self.snapshots).join(
                self.nodes().withColumnRenamed("node", "asset"), ["snapshot", "asset"], "left_semi")
            n_rows = P.in_windows(self.cal.select("date"), self.snapshots).groupBy("snapshot").agg(F.count("*").alias("n_rows"))
            raw = P.balance(rows, n_rows, min_rows=s.min_rows, min_assets=1, std_floor=-1.0, bound=1e300)
            near = pairs.strongest_neighbours(self._guarded(), s.n_controls + 1, pairs.adcc_block, extra=["a", "b", "g"])
            tests = direction.ordered_tests(self.sparse()[0], pairs.vectors(raw), near, s.n_controls)
            ev = direction.with_rule(direction.evidence(tests, s.lag, (s.granger_lag,)), s.alpha, s.tau, s.floor)
            return direction.decide(ev, s.method)

        return self._table("decisions", build)

    def arcs(self) -> DataFrame:
        return self._table("arcs", lambda: direction.arcs(self.decisions()))

    # stage 4
    def ranks(self) -> DataFrame:
        return self._table("ranks", lambda: G.pagerank(self.arcs(), self.nodes()))

    def communities(self) -> DataFrame:
        return self._table("communities", lambda: community.louvain(G.undirected(self.arcs()), self.nodes()))

    def clustering(self) -> DataFrame:
        return self._table("clustering", lambda: nulls.er_test(self.arcs(), self.nodes(), self.set.n_er_sims))

    def motifs(self) -> DataFrame:
        return self._table("motifs", lambda: nulls.motif_test(self.arcs(), self.set.n_rewires))

    def strong_pairs(self) -> DataFrame:
        """Threshold network of the window correlations at the shared edge budget."""
        def build():
            budget = pairs.edge_budget(self.residual_windows().select("snapshot", "asset").distinct())
            return pairs.strongest_pairs(self._guarded(), budget, pairs.adcc_block, extra=["a", "b", "g"])

        return self._table("strong_pairs", build)

    def density_matched(self) -> DataFrame:
        return self._table("density_matched", lambda: nulls.threshold_quality(
            self.strong_pairs(), self.nodes(), self.sectors, self.set.n_er_matched))

    def network(self) -> DataFrame:
        """One row per window with every network metric."""
        def build():
            a, n = self.arcs(), self.nodes()
            rho = self.correlations().groupBy("snapshot").agg(F.avg("v").alias("mean_corr"))
            conc = G.concentration(self.ranks()).withColumnRenamed("hhi_top", "hhi_top10").drop("n_nodes")
            t = (
                self.snapshots.select("snapshot", "regime").join(G.mean_degree(a, n), "snapshot").join(rho, "snapshot")
                .join(conc, "snapshot")
                .join(G.reciprocity(a), "snapshot", "left")
                .join(G.modularity(G.undirected(a), self.communities()), "snapshot", "left")
                .join(G.purity(self.communities(), self.sectors), "snapshot", "left")
                .join(G.cross_sector(self.strong_pairs(), self.sectors).select("snapshot", "cs_fraction"), "snapshot", "left")
                .join(self.clustering().select("snapshot", "z_c", "z_l", "sigma", "is_non_random"), "snapshot", "left")
            )
            if self.set.motifs:
                m = self.motifs().select("snapshot", "z_030t", "z_021d", "z_111d", "sp_030t", "sp_021d", "sp_111d")
                t = t.join(m, "snapshot", "left").withColumn("z_ffl", F.col("z_030t"))
            else:
                t = t.withColumn("z_ffl", F.lit(0.0))
            return t

        return self._table("network", build)

    # stage 5
    def stress(self) -> DataFrame:
        return self._table("stress", lambda: stress.snapshot_index(self.network()))

    def volume_weighted(self) -> DataFrame:
        def build():
            w = stress.log_volume_weights(self.nodes(), self.adv)
            ch = stress.volume_weighted_channels(self._guarded(), self.arcs(), self.ranks(), w,
                                                 pairs.adcc_block, ["a", "b", "g"])
            return stress.volume_weighted_index(ch, self.network().select("snapshot", "regime", "z_ffl"))

        return self._table("volume_weighted", build)

    def metrics(self) -> DataFrame:
        t = self.stress().select(
            "snapshot", "regime", "nsi", "gini", "hhi", F.abs(F.coalesce("z_111d", F.lit(0.0)) if self.set.motifs else F.lit(0.0)).alias("abs_z_mr"),
            (100 * F.coalesce("mutual_fraction", F.lit(0.0))).alias("mutual_dyad_pct"), F.col("cs_fraction").alias("cross_sector"),
            F.col("mean_corr").alias("mean_rho"))
        return inference.unpivot(t, ["nsi", "gini", "hhi", "abs_z_mr", "mutual_dyad_pct", "cross_sector", "mean_rho"])

    def tests(self) -> DataFrame:
        m = self.metrics()
        p = inference.permutation_test(m)
        return inference.adjust(p).join(inference.cohen_d(m), "metric")

    def checks(self) -> DataFrame:
        edges, sel, grid = self.sparse()
        return quality.union(
            quality.parameters(self.parameters()), quality.volatility(self.volatility()), quality.correlations(self.correlations()),
            quality.definiteness(self.correlations()), quality.tiers(sel), quality.sparse_edges(edges, sel, grid),
            quality.directions(self.arcs(), direction.tally(self.decisions())),
            quality.network(self.ranks(), self.communities(), self.motifs() if self.set.motifs else None), quality.stress(self.stress()),
            quality.same_members(self.residual_windows(), self.nodes().withColumnRenamed("node", "asset"), "cross", "members_equal"))

    def run(self) -> dict[str, DataFrame]:
        """All stages; returns the headline tables."""
        return {"network": self.network(), "stress": self.stress(), "tests": self.tests(), "checks": self.checks()}

