"""Session, table access and regex helpers shared by every job."""
