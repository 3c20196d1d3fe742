"""What tests share."""

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(df, columns, rows):
    """Equal as bags of rows, columns by name, doubles to six places."""
    show = lambda v: round(float(v), 6) if isinstance(v, float) else v
    bag = lambda cols, rows: sorted(repr(tuple(show(r[i]) for i in sorted(range(len(cols)), key=cols.__getitem__))) for r in rows)
    assert sorted(df.columns) == sorted(columns)
    assert bag(df.columns, df.collect()) == bag(columns, rows)
