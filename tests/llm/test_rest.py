"""Between the stages of the pipeline the driver gives back what it no longer needs."""

from skein.llm import common


def test_the_driver_drops_what_is_gone(spark):
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    used = lambda: heap.totalMemory() - heap.freeMemory()
    common.rest(spark)
    held = spark.sparkContext._gateway.new_array(jvm.byte, 64 << 20)
    before = used()
    del held
    common.rest(spark)
    assert before - used() > 48 << 20
