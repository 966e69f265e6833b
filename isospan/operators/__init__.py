"""Network building, scenarios, reachability, impact and reports, all on DataFrames."""
