"""The bootstrap's point gain and interval, as the reference has them, from 2,000 draws."""

from gustline import plans


def test_interval_of_all_draws(spark):
    row = plans.QUERIES["day_block_interval"](spark, "/root/testdata/sf0.001").first()
    assert row.draws == 2000 and row.low < row.high and row.low <= row.gain <= row.high
