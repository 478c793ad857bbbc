from planarix.plans import workflows


def test_medial_axes_of_every_tissue(spark, sf_dir):
    tissues = spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    assert workflows.medial_axes(spark, sf_dir).select("uid").distinct().count() == tissues == 25
