import pandas as pd


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(
            lambda v: "∅"
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v)
            else (f"{v:.9g}" if isinstance(v, float) else str(v))
        )
    # Whole numbers may arrive as floats when a column holds nulls.
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False)


def rows(df) -> list[tuple]:
    """Collected rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
