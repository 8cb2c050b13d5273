"""How the default settings of the toxicity model were chosen: cross-validation inside the learning rows of a folder of tables.

python -m tests.llm.choose_toxicity [folder]
"""

import sys

from pyspark.sql import SparkSession

from folia.llm import toxicity
from folia.llm.common import table

GRID = [{"alpha": a, "l1": l1} for a in (0.3, 0.5, 1.0, 2.0, 4.0) for l1 in (2.0, 4.0, 8.0)]


def learning_rows(spark, data):
    return toxicity.labelled_rows(table(spark, data, "documents"), table(spark, data, "labels").where(~toxicity.held_out("doc_id", 5, 0)))


if __name__ == "__main__":
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    results = toxicity.choose(learning_rows(spark, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"), GRID)
    for loss, settings in results:
        print(f"{loss:.5f} {settings}")
    print("picked", toxicity.picked(results))
