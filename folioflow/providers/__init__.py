"""Recognition behind an interface: image kernels, providers, gating and retries."""
