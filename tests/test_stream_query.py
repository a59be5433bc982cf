"""The registered stream query against its statement."""

from conftest import SF
from oracle import compare, connect

from vaultlens.plans import registry


def test_stream_windows(spark):
    assert compare(registry.QUERIES["stream_windows"](spark, SF), connect(SF), registry.ORACLE["stream_windows"])
