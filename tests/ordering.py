"""Rows in a fixed order, for comparison with pandas."""


def in_order(df):
    return df.toPandas().sort_values(["region_id", "day_idx"]).reset_index(drop=True)
