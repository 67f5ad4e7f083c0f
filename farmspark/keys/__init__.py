"""Registered keys; importing this package fills :mod:`farmspark.registry`."""

from farmspark.keys import reads_metrics  # noqa: F401
from farmspark.keys import reports_keys  # noqa: F401
from farmspark.keys import changes_keys  # noqa: F401
from farmspark.keys import notices_keys  # noqa: F401
from farmspark.keys import lookups_keys  # noqa: F401
from farmspark.keys import streams_keys  # noqa: F401
from farmspark.keys import snapshot_keys  # noqa: F401
