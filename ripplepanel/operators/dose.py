"""Effects by treatment strength: zone doses, a quadratic response, dose bins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplepanel.functions.columns import right_closed_bin
from ripplepanel.functions.ranking import exact_quantiles
from ripplepanel.operators.within import Z95, Fit, fit_two_way
from ripplepanel.policy import Policy


def zone_dose(panel: DataFrame, policy: Policy, fee_col: str = "avg_cbd_fee") -> DataFrame:
    """Mean fee per zone after the shock."""
    return panel.where(F.col("date") >= policy.shock_lit()).groupBy("zone_id").agg(
        F.avg(fee_col).alias("zone_dose"))


def join_dose(panel: DataFrame, policy: Policy, fee_col: str = "avg_cbd_fee") -> DataFrame:
    """Dose attached to every row; a zone without one gets 0."""
    return panel.join(zone_dose(panel, policy, fee_col), "zone_id", "left").withColumn(
        "zone_dose", F.coalesce("zone_dose", F.lit(0.0)))


@dataclass(frozen=True)
class DoseResponse:
    fit: Fit
    quadratic: bool
    max_dose: float
    panel: DataFrame

    def coefficients(self) -> DataFrame:
        lin, quad = self.fit.summary("post_x_dose"), {"coef": 0.0, "se": None}
        if self.quadratic:
            quad = self.fit.summary("post_x_dose_sq")
        return self.panel.sparkSession.createDataFrame(
            [(self.fit.outcome, lin["coef"], quad["coef"], lin["se"], quad["se"], lin["p_value"],
              self.fit.n_obs, self.fit.r_squared)],
            "outcome string, beta_linear double, beta_quad double, se_linear double, "
            "se_quad double, p_linear double, n_obs long, r_squared double")

    def curve(self, points: int = 100) -> DataFrame:
        """Predicted effect on an even grid from 0 to the largest dose.

        The outer band is the delta method over both terms; the _linear band
        uses the error of the linear term alone.
        """
        b1, b2 = self.fit.beta[0], self.fit.beta[1] if self.quadratic else 0.0
        v11 = self.fit.cov[0, 0]
        v12, v22 = (self.fit.cov[0, 1], self.fit.cov[1, 1]) if self.quadratic else (0.0, 0.0)
        d = F.col("id") * F.lit(self.max_dose / (points - 1))
        grid = self.panel.sparkSession.range(points).select(d.alias("dose"))
        x = F.col("dose")
        effect = F.lit(float(b1)) * x + F.lit(float(b2)) * x * x
        variance = (F.lit(float(v11)) * x * x + F.lit(2 * float(v12)) * x * x * x
                    + F.lit(float(v22)) * x * x * x * x)
        band = F.sqrt(F.greatest(variance, F.lit(0.0))) * Z95
        narrow = F.abs(F.lit(float(v11) ** 0.5) * x) * Z95
        return grid.select(
            "dose", effect.alias("effect"),
            (effect - band).alias("ci_low"), (effect + band).alias("ci_high"),
            (effect - narrow).alias("ci_low_linear"), (effect + narrow).alias("ci_high_linear"))


def continuous_did(
    panel: DataFrame, policy: Policy, outcome: str = "log_trip_count",
    fee_col: str = "avg_cbd_fee", quadratic: bool = True,
) -> DoseResponse:
    """y = unit + time + b1 * post * dose (+ b2 * post * dose squared)."""
    dosed = join_dose(panel, policy, fee_col)
    names = ["post_x_dose"] + (["post_x_dose_sq"] if quadratic else [])
    crossed = dosed.withColumns({
        "post_x_dose": F.col("post") * F.col("zone_dose"),
        "post_x_dose_sq": F.col("post") * F.col("zone_dose") * F.col("zone_dose")})
    top = dosed.agg(F.max("zone_dose")).first()[0] or 0.0
    fit = fit_two_way(crossed, [outcome], names)[0]
    return DoseResponse(fit, quadratic, float(top), panel)


def dose_bin_edges(dosed: DataFrame, n_bins: int) -> list[float]:
    """Quantile edges over the distinct doses of treated zones.

    When ties leave fewer than one bin, equal widths are used instead.
    """
    doses = dosed.where(F.col("treat_binary") == 1).select("zone_dose").distinct()
    edges = list(dict.fromkeys(
        exact_quantiles(doses, "zone_dose", [i / n_bins for i in range(n_bins + 1)])))
    if len(edges) >= 2 or not edges:
        return edges
    return [edges[0] - 0.5, edges[0] + 0.5]


def dose_bin_did(
    panel: DataFrame, policy: Policy, outcome: str = "log_trip_count",
    fee_col: str = "avg_cbd_fee", n_bins: int = 5,
) -> DataFrame:
    """One DiD per dose bin of treated zones, each against all controls.

    Control rows repeat once per bin and the bin becomes a batch key, so all
    bins are one job.
    """
    dosed = join_dose(panel, policy, fee_col)
    edges = dose_bin_edges(dosed, n_bins)
    spark = panel.sparkSession
    schema = ("bin int, mean_dose double, att double, se double, ci_low double, "
              "ci_high double, p_value double, n_obs long")
    if len(edges) < 2:
        return spark.createDataFrame([], schema)
    own = F.array(right_closed_bin(F.col("zone_dose"), edges) - 1)
    every = F.array([F.lit(i) for i in range(len(edges) - 1)])
    treated = F.col("treat_binary") == 1
    spread = dosed.withColumn("bin", F.explode(F.when(treated, own).otherwise(every)))
    crossed = spread.where(F.col("bin").isNotNull()).withColumn(
        "treat_post", F.col("treat_binary") * F.col("post"))
    means = {r["bin"]: r["d"] for r in crossed.where(treated).groupBy("bin").agg(
        F.avg("zone_dose").alias("d")).collect()}
    rows = []
    for fit in fit_two_way(crossed, [outcome], ["treat_post"], by=["bin"]):
        s, bin_ = fit.summary("treat_post"), fit.key[0]
        if bin_ in means:
            rows.append((bin_, means[bin_], s["coef"], s["se"], s["ci_low"], s["ci_high"],
                         s["p_value"], fit.n_obs))
    return spark.createDataFrame(sorted(rows), schema)
