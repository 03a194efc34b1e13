"""The driver's queries over this subpackage's operators, and their SQL where SQL can say the same."""

from tillgrain.llm.queries import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10

MODULES = [op1, op2, op3, op4, op5, op6, op7, op8, op9, op10]
QUERIES = {m.NAME: m.query for m in MODULES}
ORACLES = {m.NAME: m.ORACLE_SQL for m in MODULES if m.ORACLE_SQL}
