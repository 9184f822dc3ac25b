"""Names of the queries registered by one workload module."""

import sys

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from workload import registry  # noqa: E402

print(" ".join(n for n, f in registry.QUERIES.items() if f.__module__ == "workload." + sys.argv[1]))
