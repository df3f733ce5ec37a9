"""One query per operator over the driver's tables, with SQL to compare it with."""
