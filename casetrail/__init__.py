"""Process discovery on Spark: event logs in, measured and cited findings out.

Everything here is a function from DataFrames to DataFrames. The sub-packages are

* ``sources``   - reading exports, transcripts and datasets; writing the result tables
* ``functions`` - column functions (scrubbing, parsing, guards, report cells)
* ``operators`` - mining, detectors, registers, grading, sessions, conversations
* ``streaming`` - the incremental transcript sweep
* ``plans``     - the registered queries over the given tables and their SQL twins
"""

__version__ = "0.1.0"
