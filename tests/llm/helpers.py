DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """Documents of (doc_id, text) or longer rows; with extra, columns whose names the operators use inside."""
    full = [(*r, *(None,) * (5 - len(r))) if len(r) < 5 else r for r in rows]
    out = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("n", "key", "own", "component", "tokens", "high", "ids", "c0", "n_entities", "value", "kind", "list", "rk"):
            out = out.withColumn(name, F.lit("x"))
    return out


def saved(tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
