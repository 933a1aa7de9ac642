from pyspark.sql import functions as F

from postmill.config import Config
from postmill.operators import model
from postmill.plans import pipeline


def test_run_all(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(20))
    lines = ["title,description,company,location,min_amount,max_amount,site,job_url,date_posted"]
    for i in range(60):
        title = ("Senior Scientist", "Sales Driver", "Office Clerk")[i % 3]
        text = f"{('assay pcr', 'retail', 'filing')[i % 3]} {words} n{i}"
        lines.append(f'{title},"{text}",Acme Inc,"Boston, MA",{i},{i + 10},indeed,u{i},2024-01-02')
    (tmp_path / "in.csv").write_text("\n".join(lines))
    cfg = Config(input_path=f"file://{tmp_path}/in.csv", out_dir=f"file://{tmp_path}/out", mode="fast")
    rows = pipeline.weakly_labeled(pipeline.preprocess(pipeline.load(spark, cfg), cfg), cfg)
    assert rows.count() == 60
    paths = pipeline.run_all(spark, cfg)
    kept = spark.read.csv(paths["kept_csv"], header=True).count()
    dropped = spark.read.csv(paths["dropped_csv"], header=True).count()
    assert kept + dropped == 60 and dropped > 0
    loaded = model.CalibratedClassifier.load(paths["model"])
    scored = loaded.score(rows.withColumn("t", F.concat_ws(" ", "title", "text_for_bertopic")), "t")
    means = {r["label_weak"]: r["p"] for r in scored.groupBy("label_weak").agg(F.avg("p_rnd").alias("p")).collect()}
    assert means[1] > 0.8 > 0.2 > means[0]
    assert scored.filter("p_rnd < 0 or p_rnd > 1").count() == 0
    report = pipeline.quality_report(rows.withColumn("id", F.col("row_id")), rows)
    assert report["metrics"].count() >= 4
    found, metrics = pipeline.extract_skills(rows.limit(5))
    assert metrics.first()["n_rows"] == 5 and found.count() == 5
