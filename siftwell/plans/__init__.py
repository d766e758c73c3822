"""Entry points that chain operators: detection, quality control, strategy comparison, sensitivity."""
