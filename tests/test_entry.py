import __spark_entry__


def test_entry_gives_the_line_profile(spark):
    assert __spark_entry__.entry(spark).count() == __spark_entry__.queries()["line_profile"](spark, "/root/testdata/sf0.001").count() > 0
