"""Session builder with the settings every plan here relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def package_archive() -> str:
    """The package as an archive, for workers that start where it is not installed."""
    import tempfile
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="skein-")) / "skein.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    return str(path)


def build_session(app: str = "skein", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC, ANSI and AQE on, the package shipped to the workers.  ``master`` and ``shuffle_partitions`` are left to spark-submit unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    session = builder.getOrCreate()
    session.sparkContext.addPyFile(package_archive())
    return session
