"""Where tuning profiles and run-time metrics come from."""
