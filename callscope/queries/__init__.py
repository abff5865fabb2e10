"""The engine's operators over event, order and text tables, each with the SQL its result must equal."""
