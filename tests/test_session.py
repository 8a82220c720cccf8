"""Where scratch data goes."""

import pytest

from transhume.session import DEFAULTS, scratch_dir


class Session:
    """As much of a session as the scratch folder looks at."""

    def __init__(self, **conf):
        self.values = {key.replace("_", "."): value for key, value in conf.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


def test_shared_folder_is_taken_from_the_session():
    session = Session(spark_checkpoint_dir="s3://shared/tmp/", spark_master="yarn")
    first, second = scratch_dir(session, "x"), scratch_dir(session, "x")
    assert first.startswith("s3://shared/tmp/x-") and first != second


def test_machine_local_folder_only_on_a_local_master():
    with pytest.raises(RuntimeError):
        scratch_dir(Session(spark_master="yarn"), "x")
    session = Session(spark_master="local[2]")
    assert scratch_dir(session, "x").startswith(session.get("spark.checkpoint.dir"))


def test_defaults_reach_the_session(spark):
    assert all(spark.conf.get(key) == value for key, value in DEFAULTS.items())
