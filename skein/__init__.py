"""skein: a Spark-native engine for facts about source repositories.

Every operator is a function from DataFrames to a DataFrame.  Sub-packages:

* ``functions``  column builders (ids, paths, labels)
* ``sources``    readers and stores (file trees, snapshots, commit logs)
* ``operators``  relational operators (diffs, graphs, dedup, drift, trees)
* ``streaming``  Structured Streaming counterparts
* ``plans``      registered queries and their SQL
"""

__version__ = "0.1.0"
