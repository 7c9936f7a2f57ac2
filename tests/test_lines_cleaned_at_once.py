"""Lines are cleaned by passes over their text, and nothing goes over a line's end."""

from pyspark.sql import functions as F

from scrivener.functions import text

MESSY = "a ,\n, b;\n ;c\t\t d ~\n~`e | |\n\x0b: f \x0c\n \n- g  -\nh:\ni"


def test_lines_cleaned_at_once(spark):
    row = spark.createDataFrame([(MESSY,), (None,)], "x string").select(text.clean_multiline(F.col("x")).alias("clean"), text.tidy_lines(F.col("x")).alias("tidy"), F.transform(F.split("x", "\n"), text.tidy).alias("each"))
    first, null = row.collect()
    assert first.clean == "a\nb\nc d\ne: f \x0c\ng-h\ni" and null.clean == ""
    assert first.tidy == first.each and null.tidy == [""]
