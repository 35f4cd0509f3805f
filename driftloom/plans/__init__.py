"""Registered queries: operators over the driver's tables, with the SQL that must give the same rows."""
