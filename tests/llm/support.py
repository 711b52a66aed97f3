"""What several tests of this folder share."""


def same_rows(df, cursor):
    """The DataFrame and the DuckDB result have the same columns and rows."""
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(str(r[n]) for n in sorted(names)) for r in df.collect()))
    want = sorted((tuple(str(v) for _, v in sorted(zip(names, r, strict=True))) for r in cursor.fetchall()))
    assert len(got) == len(want)
    off = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not off, off[:3]
