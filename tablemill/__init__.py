"""Instruction-corpus curation and catalogue processing as plain DataFrame functions.

Nothing here holds a session or runs a query on import: every public function takes DataFrames
or Columns and returns DataFrames or Columns.
"""
