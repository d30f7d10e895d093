"""Memory that executors keep outside the heap and in workers."""

from __future__ import annotations

from pyspark.sql import functions as F

from exprlake.llm import packing
from exprlake.llm import queries as llm_queries
from exprlake.session import materialize


def test_scratch_tables_keep_little_direct_memory(spark):
    """Rows of 2 MB come in pages of their own, and neither the codec nor the reader keeps what holds all of them."""
    jvm = spark.sparkContext._jvm
    pool = jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean")

    def direct() -> int:
        pools = jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(pool)
        return sum(p.getMemoryUsed() for p in pools if p.getName() == "direct")

    digits = F.expr("concat_ws('', transform(sequence(1, 32768), i -> sha2(concat(id, '-', i), 256)))")
    before = direct()
    table = materialize(spark.range(0, 40, 1, 1).select("id", digits.alias("digits")), "large-rows")
    assert table.agg(F.sum(F.length("digits"))).first()[0] == 40 * 32768 * 64
    assert direct() - before < 24 << 20

    file = jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0])
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    columns = [block.getColumns()[1] for block in reader.getFooter().getBlocks()]
    assert sum(reader.readOffsetIndex(c).getPageCount() for c in columns) >= 20
    reader.close()


def test_a_worker_holds_one_vocabulary():
    encoder = packing._Encoder(llm_queries.tokenizer_path())
    encoder.encode("it's a text of plain words")
    assert encoder.tokenizer is None
    encoder.encode("a <|endoftext|> b")
    assert encoder.tokenizer is not None
