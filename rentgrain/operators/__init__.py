"""The operators: functions from tables to a lazy DataFrame.

Two habits run through all of them:

* Facts are summed to the key they are joined on *before* the join (payments to leases,
  leases to units, units to properties). Each step is a partial aggregate, so a key that
  holds a third of all rows is folded before the shuffle, and no join multiplies rows.
* The day is always the argument ``as_of``; nothing reads the clock.

No join carries a broadcast hint: Spark broadcasts a side whose measured size is under its
threshold and sort-merges otherwise, splitting skewed partitions.
"""
