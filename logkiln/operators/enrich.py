"""Host names for records without one, and the union of the two inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logkiln.staging import stage

#: Largest host table sent to every executor; a row is an address and a name.
MAX_BROADCAST_HOSTS = 1_000_000


class HostTable:
    """A host table (ip, name) that is read once for many batches, and again when its version is another.

    Of several names for one address the first in order counts. The names are kept as a stored table with their number known.
    """

    def __init__(self, hosts: DataFrame | Callable[[], DataFrame], version: Callable[[], object] | None = None):
        self._hosts = hosts if callable(hosts) else lambda: hosts
        self._version = version or (lambda: None)
        self._kept: tuple[object, DataFrame, int] | None = None

    def names(self) -> tuple[DataFrame, int]:
        """Rows (_ip, _name), and how many."""
        version = self._version()
        if self._kept is None or self._kept[0] != version:
            names = stage(self._hosts().where(F.col("ip").isNotNull()).groupBy(F.col("ip").alias("_ip")).agg(F.min("name").alias("_name")))
            self._kept = (version, names, names.count())
        return self._kept[1:]


def resolve_hostnames(
    logs: DataFrame, hosts: DataFrame | HostTable, max_broadcast_hosts: int = MAX_BROADCAST_HOSTS, salts: int = 64
) -> DataFrame:
    """Fill null host names with the name of ``src_ip``, or the address itself if unknown.

    An empty host name is a name. ``hosts`` has columns ip and name; of several names for one
    address the first in order counts, so rows never multiply. Within the limit the names
    are broadcast; beyond it both sides are spread over ``salts``, as a few senders
    can account for most rows. Batches of a stream share a ``HostTable``.
    """
    names, size = (hosts if isinstance(hosts, HostTable) else HostTable(hosts)).names()
    wanted = logs.withColumn("_wanted", F.when(F.col("hostname").isNull(), F.col("src_ip")))
    if size <= max_broadcast_hosts:
        joined = wanted.join(F.broadcast(names), F.col("_wanted") == F.col("_ip"), "left")
    else:
        spread = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_key", F.concat_ws("/", "_salt", "_ip"))
        salt = F.pmod(F.xxhash64("src_ip", "source_timestamp", "message"), F.lit(salts)).cast("int")
        # Rows that have a name find none, but each under a key of its own, so that they do not share a null one.
        own = F.concat(F.lit("-/"), F.xxhash64("src_ip", "source_timestamp", "message").cast("string"))
        key = F.when(F.col("_wanted").isNotNull(), F.concat_ws("/", salt, "_wanted")).otherwise(own)
        joined = wanted.withColumn("_wanted_key", key).join(spread, F.col("_wanted_key") == F.col("_key"), "left")
    return joined.withColumn("hostname", F.coalesce("hostname", "_name", "src_ip")).select(*logs.columns)


def merge_logs(gelf: DataFrame, syslog: DataFrame) -> DataFrame:
    """All records of both inputs, in no order; tables or streams."""
    return gelf.unionByName(syslog)
