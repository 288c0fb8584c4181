"""Reading inputs and laying them out."""
