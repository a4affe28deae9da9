"""The policy being measured: one shock date plus the zones it touches."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Parameters every operator takes instead of hard-coded dates and zones."""

    shock: date
    core: tuple[int, ...]
    buffer: tuple[int, ...] = ()
    airports: tuple[int, ...] = ()
    announcement: date | None = None
    home_borough: str = "Manhattan"
    center_lat: float = 40.754
    center_lon: float = -73.984
    max_zone: int = 265
    borough_codes: dict[str, int] = field(default_factory=dict)
    holidays: tuple[date, ...] = ()

    def shock_lit(self) -> Column:
        return F.lit(self.shock)

    def is_post(self, day: Column) -> Column:
        return day >= self.shock_lit()

    def rel_week(self, week: Column) -> Column:
        """Whole weeks from the shock to a week start, rounded down.

        The floor matters: a week that starts a day before a Sunday shock is
        week -1, where an integer division would say 0.
        """
        return F.floor(F.datediff(week, self.shock_lit()) / F.lit(7)).cast("int")


# The congestion zone, its neighbours, the airports, the borough
# codes and the public holidays of the study window.
CITY_POLICY = Policy(
    shock=date(2025, 1, 5),
    announcement=date(2024, 11, 1),
    core=(
        4, 12, 13, 24, 41, 42, 43, 45, 48, 50, 68, 79, 87, 88, 89, 90,
        100, 103, 104, 105, 107, 113, 116, 120, 125, 126, 127, 128,
        144, 148, 151, 152, 153, 158, 161, 162, 163, 164, 166, 170,
        186, 194, 202, 209, 211, 224, 229, 230, 231, 232, 233, 234,
        236, 237, 238, 239, 243, 244, 246, 249, 261, 262, 263,
    ),
    buffer=(17, 25, 36, 37, 74, 75, 76, 77, 112, 140, 168, 255),
    airports=(1, 132, 138),
    borough_codes={
        "Manhattan": 1, "Bronx": 2, "Brooklyn": 3, "Queens": 4,
        "Staten Island": 5, "EWR": 6,
    },
    holidays=(
        date(2024, 7, 4), date(2024, 9, 2), date(2024, 10, 14),
        date(2024, 11, 11), date(2024, 11, 28), date(2024, 12, 25),
        date(2025, 1, 1), date(2025, 1, 20), date(2025, 2, 17),
        date(2025, 5, 26), date(2025, 7, 4),
    ),
)
