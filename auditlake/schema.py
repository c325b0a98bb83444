"""The record of a SQL execution log and the names of its fields."""

from __future__ import annotations

#: The fields of an exported record, in order.
FIELDS = ("ts", "ep", "sess_id", "thrd_id", "username", "trx_id", "statement", "appname", "client_ip", "tag", "sql", "exec_time_ms", "row_count", "exec_id", "normalized_sql")
#: Fields that the performance tail of a record gives.
METRICS = ("exec_time_ms", "row_count", "exec_id")
#: Fields that patterns can be put on.
META_FIELDS = ("username", "client_ip", "sess_id", "thrd_id", "statement", "appname")
#: Tags of data statements.
DML_TAGS = ("INS", "DEL", "UPD", "SEL")
#: Order of records: by file, then place in it.
ORDER = ("file", "pos")
