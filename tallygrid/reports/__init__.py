"""Pages and figures, on the driver."""
