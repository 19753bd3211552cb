"""A closed loop that tries plan hints on a repeated query and keeps the fastest."""
