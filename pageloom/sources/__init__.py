"""Title lists, page tables and output templates as inputs."""
