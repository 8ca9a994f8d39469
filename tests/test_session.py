"""Session defaults and the shared checkpoint folder rule."""

import pytest

from newsloom.session import RUNTIME_DEFAULTS, checkpoint_dir, ensure_session_defaults


class _Conf:
    def __init__(self, values):
        self.values = dict(values)

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _NoContextSession:
    """A session without a local SparkContext (as in client/server setups)."""

    def __init__(self, values):
        self.conf = _Conf(values)

    @property
    def sparkContext(self):
        raise RuntimeError("no local SparkContext")


def test_cluster_without_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_NoContextSession({"spark.master": "yarn"}))


def test_configured_checkpoint_dir_is_used_and_local_fallback_allowed():
    s = _NoContextSession({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://nn/ckpt/"})
    assert checkpoint_dir(s) == "hdfs://nn/ckpt"
    local = _NoContextSession({"spark.master": "local[2]"})
    assert checkpoint_dir(local).startswith("/")


def test_runtime_defaults_applied(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    ensure_session_defaults(spark)
    for k, v in RUNTIME_DEFAULTS.items():
        assert spark.conf.get(k) == v
