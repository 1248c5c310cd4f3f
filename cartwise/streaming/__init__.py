"""No stream operators: every supported input is a finite table.

The nearest operation is the family of sliding snapshots, which is a batch range join and
lives in :mod:`cartwise.plans.rolling`.
"""
