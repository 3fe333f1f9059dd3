import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """Runs oracle SQL over a data folder; rows as sorted text, columns by name."""
    import duckdb

    def run(sql: str, folder: str) -> list[str]:
        c = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        r = c.execute(sql)
        names = [d[0] for d in r.description]
        return rows_of(names, r.fetchall())

    return run


def plain(v):
    return float(v) if type(v).__name__ == "Decimal" else round(v, 9) + 0.0 if isinstance(v, float) else v


def rows_of(names, rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([(names[i], plain(r[i])) for i in order]) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql: str, folder: str) -> None:
        df = query(spark, folder)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == duck(sql, folder)

    return check
