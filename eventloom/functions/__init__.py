"""Column functions of particle kinematics, and the registry of external functions."""
