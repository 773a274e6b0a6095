"""Code-repository analytics as Spark DataFrame jobs.

Every public function takes DataFrames and returns a DataFrame keyed by ``repo_id``.
"""
