"""All registered queries: name -> (function of session and folder, SQL or None)."""

from . import suite_functions, suite_match, suite_records, suite_tables

SUITES = [suite_records, suite_tables, suite_functions, suite_match]

ALL: dict = {}
for _suite in SUITES:
    for _name, _entry in _suite.QUERIES.items():
        if _name in ALL:
            raise ValueError(f"query {_name} is registered twice")
        ALL[_name] = _entry
