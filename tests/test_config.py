from wardspark import config


def test_layers(spark, tmp_path):
    assert config.load(folders=[tmp_path], env={}) == config.DEFAULTS
    (tmp_path / "wardspark.toml").write_text('base_ref = "dev"\nverbose = true\nown = 3\n')
    assert config.load(folders=["/nowhere", tmp_path], env={}) == config.DEFAULTS | {"base_ref": "dev", "verbose": True, "own": 3}
    (tmp_path / ".wardspark.toml").write_text('base_ref = "first"')
    env = {"WARDSPARK_VERBOSE": "Yes", "WARDSPARK_QUIET": "0", "WARDSPARK_NO_COLOR": "1", "WARDSPARK_OUTPUT_DIR": "o", "WARDSPARK_COLOR": "1", "WARDSPARK_FAIL_ON": "low", "WARDSPARK_REPORT_FORMAT": "md"}
    assert config.load(folders=[tmp_path], env=env) == config.DEFAULTS | {"base_ref": "first", "verbose": True, "quiet": False, "color": False, "output_dir": "o", "fail_on_severity": "low"}
    spark.conf.set("wardspark.output_dir", "s")
    spark.conf.set("wardspark.color", "true")
    try:
        assert {k: config.load(tmp_path / "wardspark.toml", env=env, spark=spark)[k] for k in ("output_dir", "color", "base_ref")} == {"output_dir": "s", "color": True, "base_ref": "dev"}
    finally:
        spark.conf.unset("wardspark.output_dir")
        spark.conf.unset("wardspark.color")


def test_broken_files_count_as_none(tmp_path):
    (tmp_path / "x.toml").write_text("a = ")
    assert config.load(tmp_path / "x.toml", env={}) == config.load(tmp_path / "none.toml", env={}) == config.DEFAULTS
