"""All registered queries. Importing this package fills the registry."""

from tracewell.plans.catalogue import (  # noqa: F401
    activity, daily, files_streams, joins_sets, scalars, scoring, sessions_routing, streams_sources, tools, windows)
