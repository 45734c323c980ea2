"""paystrata: payroll analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames. Clock values (``run_ts``,
``as_of``) are arguments, money is exact decimal, and ranking never gathers a
table, a department or a period into one task.
"""

__version__ = "0.1.0"
