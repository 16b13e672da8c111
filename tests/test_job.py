import pytest
from test_batch import write_raw

from tidemark.__main__ import LOGIN_CONF, arguments, job_config, main, stream_source
from tidemark.operators.events import dq_event_contract
from tidemark.operators.quality import QualityError
from tidemark.sources.runs import scan_runs
from tidemark.sources.tables import scan_table
from tidemark.streaming.bronze import last_batch, scan_events


def test_steps_one_by_one(spark, tmp_path):
    raw, base = write_raw(tmp_path / "raw.csv", 300), str(tmp_path / "lake")
    options = ["--base", base, "--raw", raw, "--min-rows", "300", "--rounds", "2"]
    main(["silver", *options])
    with pytest.raises(QualityError):
        main(["gold", "--base", base])
    main(["gold", *options])
    main(["train", *options])
    assert scan_table(spark, f"{base}/gold/features").count() == 300
    assert scan_runs(spark, f"{base}/models/runs").first().params["n_estimators"] == "2"


def test_settings_reach_the_config():
    options = "--infer-schema --prefer-complete --depth 3 --learning-rate 0.2 --test-share 0.3 --input-bytes 10".split()
    args = arguments(["batch", "--base", "b", "--raw", "r", *options])
    config = job_config(args)
    assert config.infer_schema and config.prefer_complete and args.input_bytes == 10
    assert (config.model.depth, config.model.learning_rate, config.model.test_size) == (3, 0.2, 0.3)


def test_stream_sources(spark, tmp_path):
    to = ["--path", "p", "--checkpoint", "c"]
    assert stream_source(spark, arguments(["stream", "--source", "in", *to])).options == {"maxFilesPerTrigger": "10000"}
    by_bytes = arguments(["stream", "--source", "in", "--bytes-per-batch", "9", *to])
    assert stream_source(spark, by_bytes).options == {"maxBytesPerTrigger": "9"}
    topic = ["stream", "--topic", "t", "--servers", "h:9093", *to]
    with pytest.raises(ValueError, match="login"):
        stream_source(spark, arguments(topic))
    (tmp_path / "login").write_text("secret\n")
    source = stream_source(spark, arguments([*topic, "--login-file", str(tmp_path / "login"), "--min-partitions", "8"]))
    assert source.fmt == "kafka" and source.options["kafka.sasl.jaas.config"] == "secret"
    assert source.options["maxOffsetsPerTrigger"] == "50000000" and source.options["minPartitions"] == "8"
    spark.conf.set(LOGIN_CONF, "from the session")
    assert stream_source(spark, arguments(topic)).options["kafka.sasl.jaas.config"] == "from the session"
    spark.conf.unset(LOGIN_CONF)
    with pytest.raises(SystemExit):
        arguments(["stream", "--topic", "t", *to])
    with pytest.raises(SystemExit):
        arguments(["stream", "--topic", "t", "--source", "in", *to])


def test_limited_file_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text("not json\n")
    to = ["--path", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "cp"), "--files-per-batch", "1"]
    main(["stream", "--source", str(folder), *to])
    assert last_batch(spark, str(tmp_path / "cp")) == 2


def test_events_to_table(spark, tmp_path):
    folder = str(tmp_path / "in")
    stream = ["stream", "--source", folder, "--path", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "cp")]
    main(["events", "--path", folder])
    main(stream)
    main(["events", "--path", folder, "--count", "20", "--first", "100"])
    main(stream)
    events = scan_events(spark, str(tmp_path / "out"))
    assert events.count() == events.select("customer_id").distinct().count() == 120
    assert all(r.violations == 0 for r in dq_event_contract(events).collect())
